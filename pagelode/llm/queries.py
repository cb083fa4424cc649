"""The operators as queries over the given tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm import bpe, importance, langid, lines, mih, mixing, packing, rabitq, repair, repeats, simhash, toxicity, transcripts
from pagelode.llm.shared import Scratch, table

def remainder(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for every hundredth one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return mih.search(rows, rows.filter("vec_id % 100 = 0"), Scratch(spark))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    docs, added = table(spark, sf_dir, "documents"), packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 2, 1024, added=added), 1024, Scratch(spark)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose SimHash fingerprints differ in at most two bits."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the text they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded"))


def raw_transcript():
    """A turn as people paste it: three in four carry a speaker marker of one of several styles, the rest none; three in four follow a blank line, the rest a line break."""
    role, n = F.col("role"), F.pmod(F.xxhash64("conv_id"), F.lit(4))
    name = F.when(n == 0, F.initcap(role)).when(n == 1, F.expr("map('system', 'Context', 'user', 'Human', 'assistant', 'AI')[role]")).when(n == 2, F.expr("map('system', 'Instructions', 'user', 'Q', 'assistant', 'A')[role]")).otherwise(role)
    text = F.coalesce("text", F.lit(""))
    marked = F.when(n == 3, F.concat(F.lit("<|"), name, F.lit("|>"), text)).otherwise(F.concat(name, F.lit(": "), text))
    shown = F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) == 0, text).otherwise(F.coalesce(marked, text))
    return F.concat(F.when(F.pmod(F.xxhash64("turn", "conv_id"), F.lit(4)) == 0, "").otherwise("\n"), shown)


@query
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns recovered from transcripts of all conversations, with the role each had, for comparison.

    The model is counted over the conversations whose id leaves 0 divided by 5.
    """
    scratch = Scratch(spark)
    raw = table(spark, sf_dir, "conversations").withColumn("raw", raw_transcript())
    lines = scratch.cut(transcripts.symbols(transcripts.lines_of(raw, text="raw", carry=("role",))))
    truth = F.expr("2 * (array_position(array('system', 'user', 'assistant'), role) - 1) + IF(opens, 0, 1)").cast("int")
    model = transcripts.estimate(transcripts.counted(lines.filter("conv % 5 = 0").withColumn("state", truth).filter("state >= 0")))
    found = transcripts.parse(lines, model, scratch)
    known = lines.filter("opens").select("conv", F.col("pos").alias("start"), F.col("role").alias("true_role"))
    out = found.join(known, ["conv", "start"], "left")
    return out.select(F.col("conv").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "content", "rendered", "true_role", (F.col("conv") % 5 != 0).alias("held_out"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from labelled rows outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return toxicity.score(docs.drop("lang"), model).select("doc_id", (remainder(5) == 0).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_pred").alias("predicted"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from rows outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, remainder(4) != 2)
    return langid.identify(docs.drop("lang"), model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


@query
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document under 200-byte strings that also start elsewhere."""
    docs = table(spark, sf_dir, "documents")
    affected = repeats.Repeats(docs, Scratch(spark)).affected.select("key", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    rows = docs.select("doc_id", repeats.text_key().alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.join(affected, "key", "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("sha", F.lower(F.hex("key"))).alias("kept_sha256"))


@query
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of vectors with equal labels and a cosine of at least 0.93."""
    return rabitq.near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of all pages without those on more than a tenth of their host's pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", lines.host_of(F.col("url")).alias("host"), lines.page_lines(F.col("html")).alias("text"))
    return lines.dedup(pages, Scratch(spark), host="host")


ORACLE["op10_line_dedup"] = r"""
WITH stripped AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/:?#]+)', 2)), '') AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '<(script|style)[^>]*>.*?</(script|style)\s*>', '', 'gsi'), '<!--.*?-->', '', 'gs'),
      '</?(p|div|li|ul|ol|h[1-6]|article|section|nav|header|footer|aside|main|table|tr|td|th|br|hr|title|head|body|html|blockquote|pre|form|dl|dt|dd|figure|option|button)(\s[^>]*)?>', chr(10), 'gi'),
      '<[^>]*>', '', 'g') AS t
  FROM pages
), page AS (
  SELECT page_id, host, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls FROM stripped
), per AS (
  SELECT DISTINCT page_id, host, unnest(ls) AS line FROM page WHERE host IS NOT NULL
), total AS (SELECT host, count(*) AS total FROM page WHERE host IS NOT NULL GROUP BY host
), bad AS (
  SELECT host, line FROM (SELECT host, line, count(*) AS n FROM per GROUP BY host, line) JOIN total USING (host) WHERE n > total * 0.1
), drops AS (SELECT host, list(line) AS drop_lines FROM bad GROUP BY host
), kept AS (
  SELECT page_id, page.host, ls, CASE WHEN drop_lines IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(drop_lines, x)) END AS k
  FROM page LEFT JOIN drops ON page.host = drops.host
)
SELECT page_id, host, array_to_string(k, chr(10)) AS text, greatest(len(ls), 1)::INTEGER AS n_lines, (len(ls) - len(k))::INTEGER AS n_dropped FROM kept
"""


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of all documents, drawn towards the words of the benchmark."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark))


#: CRC-32 of a text's UTF-8 bytes in SQL: `crc` is the table of its 256 steps.
CRC = r"""crc AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b::BIGINT] || range(8)::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))
)"""


def crc32_sql(f: str) -> str:
    return f"""xor(4294967295, list_reduce([4294967295] || list_transform(range(octet_length(encode({f}))), lambda i: ('0x' || substr(hex(encode({f})), 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""


ORACLE["op11_importance_resampling"] = rf"""
WITH {CRC}, texts AS (
  SELECT true AS doc, row_number() OVER () AS id, doc_id, text FROM documents UNION ALL SELECT false, NULL, NULL, text FROM benchmark
), words AS (
  SELECT doc, id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS (
  SELECT doc, id, f, count(*) AS n FROM (SELECT doc, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words) GROUP BY ALL
), hashed AS (
  SELECT f, {crc32_sql("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM features), crc
), counted AS (SELECT doc, id, bucket, sum(n) AS n FROM features JOIN hashed USING (f) GROUP BY ALL
), buckets AS (SELECT bucket, coalesce(sum(n) FILTER (doc), 0) AS s, coalesce(sum(n) FILTER (NOT doc), 0) AS t FROM counted GROUP BY bucket
), totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM buckets
), gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS g FROM buckets, totals
), weights AS (SELECT id, floor(sum(n * g)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM counted JOIN gain USING (bucket) WHERE doc GROUP BY id
), scored AS (
  SELECT doc_id, len(w) AS words, (len(w) + greatest(len(w) - 1, 0))::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (id) WHERE doc
), ranked AS (SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * (SELECT count(*) FROM scored WHERE words >= 20) // 100 THEN place END AS rank FROM ranked
"""


@query
def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights of their sources, half as much again as there is."""
    return mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark))


ORACLE["op12_source_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS turn, row_number() OVER () AS id FROM documents
), s AS (
  SELECT source, source_size, place, [5, 2, 1][place % 3 + 1] AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source)
), steps AS (
  SELECT *, 2 * source_size / w AS reach,
    coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
    sum(w) OVER (ORDER BY 2 * source_size / w DESC, place DESC)::BIGINT AS open_w
  FROM s
), level AS (
  SELECT l FROM (SELECT (1.5 * (SELECT sum(source_size) FROM s)::DOUBLE - capped) / open_w AS l, reach, place FROM steps) WHERE l <= reach ORDER BY reach, place LIMIT 1
), aims AS (
  SELECT source, source_size, place, least((2 * source_size)::DOUBLE, w * l) AS target, greatest(1, ceil(source_size / 1000))::BIGINT AS piece FROM s, level
), q AS (
  SELECT id, doc_id, size, source_size, target, place, piece, greatest(1, ceil(size / piece))::BIGINT AS n,
    (sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
  FROM d JOIN aims ON d.source IS NOT DISTINCT FROM aims.source
), pieces AS (
  SELECT *, greatest(0, least(piece, size - i % n * piece)) AS words FROM (SELECT *, unnest(range(2 * n)) AS i FROM q)
), ends AS (
  SELECT *, i // n * source_size + before + i % n * piece + words AS ending FROM pieces
), line AS (
  SELECT *, (sum(words) OVER (ORDER BY CASE WHEN target > 0 THEN ending::DOUBLE / target ELSE 0 END, place, ending ROWS UNBOUNDED PRECEDING) - words)::BIGINT AS used FROM ends
)
SELECT doc_id, size, source_size, target,
  sum(greatest(0, least(words, floor(1.5 * (SELECT sum(source_size) FROM s))::BIGINT - used)))::BIGINT AS taken
FROM line GROUP BY id, doc_id, size, source_size, target
"""


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and repaired text of every damaged conversation."""
    return repair.repair(table(spark, sf_dir, "conversations"), Scratch(spark))


#: Cheapest repairs row by row from a conversation's end; c is the cost, a the audit, in the four grammar states.
ORACLE["op13_conversation_repair"] = rf"""
WITH RECURSIVE {CRC}, raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), chosen AS (SELECT *, {crc32_sql("k")} % 20 AS fault FROM raw, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM chosen WHERE fault <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    left(role, 1) AS initial, coalesce(nullif(conv_id::VARCHAR, ''), '~') AS c FROM damaged
), marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM numbered
), pairs AS (SELECT *, lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair FROM marked
), stats AS (
  SELECT c, any_value(conv_id) AS conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM pairs GROUP BY c
), best AS (
  SELECT c, n AS i, {{'c': 0, 'a': ''}} AS b0, {{'c': 6, 'a': 'II'}} AS b1, {{'c': 3, 'a': 'I'}} AS b2, {{'c': 0, 'a': ''}} AS b3 FROM stats
  UNION ALL
  SELECT c, i, list_min([o0, {{'c': least(o2.c, o3.c + 3) + 3, 'a': 'I' || list_min([o2, {{'c': o3.c + 3, 'a': 'I' || o3.a}}]).a}}]),
    list_min([o1, {{'c': least(o2.c, o3.c + 3) + 3, 'a': 'I' || list_min([o2, {{'c': o3.c + 3, 'a': 'I' || o3.a}}]).a}}]),
    list_min([o2, {{'c': o3.c + 3, 'a': 'I' || o3.a}}]), list_min([o3, {{'c': o2.c + 3, 'a': 'I' || o2.a}}])
  FROM (
    SELECT c, i,
      list_min([d0, {{'c': b2.c + no + 3, 'a': 'R' || b2.a}}, {{'c': b1.c + no + CASE WHEN initial = 's' THEN 0 ELSE 999999 END, 'a': 'K' || b1.a}}, {{'c': b2.c + no + CASE WHEN initial = 'u' THEN 0 ELSE 999999 END, 'a': 'K' || b2.a}}]) AS o0,
      list_min([d1, {{'c': b2.c + no + 3, 'a': 'R' || b2.a}}, {{'c': b2.c + no + CASE WHEN initial = 'u' THEN 0 ELSE 999999 END, 'a': 'K' || b2.a}}]) AS o1,
      list_min([d2, {{'c': b3.c + no + 3, 'a': 'R' || b3.a}}, {{'c': b3.c + no + CASE WHEN initial = 'a' THEN 0 ELSE 999999 END, 'a': 'K' || b3.a}}]) AS o2,
      list_min([d3, {{'c': b2.c + no + 3, 'a': 'R' || b2.a}}, {{'c': b2.c + no + CASE WHEN initial = 'u' THEN 0 ELSE 999999 END, 'a': 'K' || b2.a}}]) AS o3
    FROM (
      SELECT b.c, b.i - 1 AS i, b0, b1, b2, b3, initial, CASE fault WHEN 'blank' THEN 999999 WHEN 'duplicate' THEN 999999 WHEN 'truncated' THEN 3 ELSE 0 END AS no,
        {{'c': b0.c + 4, 'a': 'D' || b0.a}} AS d0, {{'c': b1.c + 4, 'a': 'D' || b1.a}} AS d1, {{'c': b2.c + 4, 'a': 'D' || b2.a}} AS d2, {{'c': b3.c + 4, 'a': 'D' || b3.a}} AS d3
      FROM best AS b JOIN marked AS m ON m.c = b.c AND m.i = b.i
    )
  )
), solved AS (SELECT c, b0.c AS cost, b0.a AS audit FROM best WHERE i = 0
), edits AS (SELECT c, unnest(range(1, length(audit) + 1)) AS p, audit FROM solved
), walked AS (
  SELECT c, p, substr(audit, p, 1) AS e, length(replace(substr(audit, 1, p), 'I', '')) AS i, length(replace(substr(audit, 1, p), 'D', '')) AS place FROM edits
), placed AS (
  SELECT w.c, p, e, place, m.role, m.text, max((e = 'K' AND initial = 's')::INT) OVER (PARTITION BY w.c) AS system
  FROM walked AS w LEFT JOIN marked AS m ON m.c = w.c AND m.i = w.i AND e <> 'I' WHERE e <> 'D'
), repaired AS (
  SELECT c, string_agg(CASE WHEN e = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS lines FROM placed GROUP BY c
), ids AS (SELECT DISTINCT conv_id, coalesce(nullif(conv_id::VARCHAR, ''), '~') AS c FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM ids LEFT JOIN stats USING (c) LEFT JOIN solved USING (c) LEFT JOIN repaired USING (c)
"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline from documents to packed sequences."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
