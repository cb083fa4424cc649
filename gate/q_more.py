"""Gate queries: remaining element tables, scalar functions, detectors, aggregates, rules, corpus, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from gate import duck as D
from gate.duck import LP, WEB, attr, chain, clip, collapse, ext, has, hasattr_, lst, rep, s
from gate.registry import detectors, register, sections, snapshot, web, web_sections
from pagelode.functions import claims as C
from pagelode.functions import hosts as H
from pagelode.functions import labels as L
from pagelode.functions import prices as P
from pagelode.functions import text as T
from pagelode.functions import urls as U
from pagelode.operators import evidence as V
from pagelode.operators import eventlog as EV
from pagelode.operators import structured as S
from pagelode.plans import classify as K
from pagelode.plans import corpus as CO
from pagelode.plans import linkchecks as LC
from pagelode.plans import roles as RO
from pagelode.plans import rules as R
from pagelode.plans.compose import compose


def docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


# =============================================================== element tables

_first = lambda cond, val: f"nullif(arg_min(coalesce({val}, ''), seq) FILTER (WHERE {cond}), '')"
_META = "SELECT page_id, seq, " + ", ".join(f"{attr(a)} AS {n}" for a, n in [("name", "name"), ("property", "property"), ("content", "content"), ("charset", "charset")]) + " FROM nd WHERE kind = 'open' AND tag = 'meta'"


@register("b07_meta_whitelist", LP.sql([], f"""SELECT p.page_id, description, robots, og_title, og_site_name, twitter_card, charset, coalesce(vp, false) AS has_viewport_meta, canonical FROM lp p
LEFT JOIN (SELECT page_id, {_first("name = 'description'", 'content')} AS description, {_first("name = 'robots'", 'content')} AS robots, {_first("property = 'og:title'", 'content')} AS og_title,
 {_first("property = 'og:site_name'", 'content')} AS og_site_name, coalesce({_first("name = 'twitter:card'", 'content')}, {_first("property = 'twitter:card'", 'content')}) AS twitter_card,
 arg_min(charset, seq) FILTER (WHERE charset IS NOT NULL) AS charset, bool_or(name = 'viewport') vp FROM ({_META}) GROUP BY page_id) m ON m.page_id = p.page_id
LEFT JOIN (SELECT page_id, nullif(arg_min(coalesce({attr('href')}, ''), seq), '') canonical FROM nd WHERE kind = 'open' AND tag = 'link' AND {attr('rel')} = 'canonical' GROUP BY page_id) c ON c.page_id = p.page_id"""))
def _(spark, d):
    return snapshot(spark, d).meta_whitelist.select("page_id", "description", "robots", "og_title", "og_site_name", "twitter_card", "charset", "has_viewport_meta", "canonical")


@register("b08_metas", LP.sql([], f"SELECT page_id, seq, {attr('name')} AS name, {attr('property')} AS property, {attr('content')} AS content FROM nd WHERE kind = 'open' AND tag = 'meta'"))
def _(spark, d):
    return snapshot(spark, d).metas.select("page_id", "seq", "name", "property", "content")


@register("b10_link_rels", LP.sql([], f"SELECT page_id, seq, {attr('rel')} AS rel, {attr('href')} AS href FROM nd WHERE kind = 'open' AND tag = 'link' AND {hasattr_('rel')}"))
def _(spark, d):
    return snapshot(spark, d).link_rels.select("page_id", "seq", "rel", "href")


_LDBODY = f"regexp_extract(tok, {s(r'(?is)^<[^>]*>(.*?)(?:</script\s*>)?\z')}, 1)"


@register("b11_json_ld", LP.sql([], f"SELECT page_id, seq, NOT json_valid({_LDBODY}) AS parse_error, CASE WHEN NOT json_valid({_LDBODY}) THEN {_LDBODY} END AS raw FROM nd WHERE kind = 'raw' AND tag = 'script' AND {attr('type')} = 'application/ld+json'"))
def _(spark, d):
    return snapshot(spark, d).json_ld.select("page_id", "seq", "parse_error", "raw")


@register("b16_sections")
def _(spark, d):
    return snapshot(spark, d).sections


_FIELDS = f"""ff AS (SELECT *, lower(coalesce({attr('type')}, '')) ty FROM nd WHERE kind IN ('open','raw') AND tag IN ('input','textarea','select')),
hasform AS (SELECT DISTINCT page_id FROM nd WHERE kind = 'open' AND tag = 'form' AND end_seq > seq),
fo AS MATERIALIZED (SELECT f.*, h.page_id IS NULL orphan, CASE WHEN h.page_id IS NULL THEN min(seq) OVER (PARTITION BY f.page_id) ELSE form_seq END fseq
  FROM (SELECT * FROM ff WHERE ty NOT IN ('hidden','submit','button','image','reset')) f LEFT JOIN hasform h ON h.page_id = f.page_id)"""


@register("b18_form_fields", LP.sql([], f"""SELECT page_id, seq, fseq AS form_seq, orphan, {attr('name')} AS name, tag, coalesce(nullif({attr('type')}, ''), CASE tag WHEN 'select' THEN 'select' WHEN 'textarea' THEN 'textarea' ELSE 'text' END) AS type,
 {hasattr_('required')} AS required, {attr('autocomplete')} AS autocomplete, {attr('placeholder')} AS placeholder FROM fo WHERE fseq IS NOT NULL""", _FIELDS))
def _(spark, d):
    return snapshot(spark, d).form_fields.select("page_id", "seq", "form_seq", "orphan", "name", "tag", "type", "required", "autocomplete", "placeholder")


@register("b19_field_labels")
def _(spark, d):
    return snapshot(spark, d).form_fields.select("page_id", "seq", "label", "purpose")


@register("b20_field_options", LP.sql([], f"""SELECT page_id, select_seq AS field_seq, seq AS o_seq, "text" FROM ox WHERE "text" <> '' AND fs IS NOT NULL
UNION ALL SELECT a.page_id, a.seq, c.seq, coalesce(nullif(c.v, ''), 'on') FROM (SELECT page_id, seq, form_seq, coalesce({attr('name')}, '') nm FROM ff WHERE form_seq IS NOT NULL AND tag <> 'select' AND ty NOT IN ('hidden','submit','button','image','reset')) a
JOIN (SELECT page_id, seq, form_seq, coalesce({attr('name')}, '') nm, {attr('value')} v FROM ff WHERE tag = 'input' AND form_seq IS NOT NULL AND ty IN ('radio','checkbox')) c ON c.page_id = a.page_id AND c.form_seq = a.form_seq AND c.nm = a.nm""",
    _FIELDS + "," + D.textof("ox", "kind = 'open' AND tag = 'option' AND select_seq IS NOT NULL", "(SELECT n.*, z.form_seq fs FROM nd n LEFT JOIN (SELECT page_id, seq, form_seq FROM nd WHERE tag = 'select') z ON z.page_id = n.page_id AND z.seq = n.select_seq)")))
def _(spark, d):
    return snapshot(spark, d).field_options.select("page_id", "field_seq", "o_seq", "text")


@register("b17_forms", LP.sql([], f"""SELECT f.page_id, seq, {D.resolve("coalesce(ac, '')", 'url')} AS action, coalesce(nullif(lower(me), ''), 'get') AS method, NOT hidden AS visible, in_modal FROM (SELECT *, {attr('action')} ac, {attr('method')} me FROM nd WHERE kind = 'open' AND tag = 'form' AND end_seq > seq) f
JOIN (SELECT page_id, url FROM lp) u ON u.page_id = f.page_id
UNION ALL SELECT page_id, min(fseq), NULL, 'unknown', true, false FROM fo WHERE orphan AND fseq IS NOT NULL GROUP BY page_id""", _FIELDS))
def _(spark, d):
    return snapshot(spark, d).forms.select("page_id", "seq", "action", "method", "visible", "in_modal")


@register("b21_orphan_form", LP.sql([], "SELECT page_id, min(fseq) AS seq, count(*) AS fields FROM fo WHERE orphan AND fseq IS NOT NULL GROUP BY page_id", _FIELDS))
def _(spark, d):
    return snapshot(spark, d).form_fields.filter("orphan").groupBy("page_id").agg(F.min("form_seq").alias("seq"), F.count("*").alias("fields"))


@register("b22_form_embeds", LP.sql([], f"SELECT page_id, form_seq, seq, tag, coalesce(nullif({attr('src')}, ''), nullif({attr('data-src')}, ''), nullif({attr('data')}, '')) AS src FROM nd WHERE kind = 'open' AND tag IN ('iframe','embed','object') AND form_seq IS NOT NULL"))
def _(spark, d):
    return snapshot(spark, d).form_embeds.select("page_id", "form_seq", "seq", "tag", "src")


@register("b23_hidden_inputs", LP.sql([], f"SELECT page_id, seq, form_seq, {attr('name')} AS name, length(coalesce({attr('value')}, '')) > 0 AS value_present FROM nd WHERE kind = 'open' AND tag = 'input' AND lower({attr('type')}) = 'hidden'"))
def _(spark, d):
    return snapshot(spark, d).hidden_inputs.select("page_id", "seq", "form_seq", "name", "value_present")


_VPROV = chain([(" OR ".join(f"contains(ls, {s(n)})" for n in ns), v) for ns, v in H.VIDEO_PROVIDERS], "'unknown'")


@register("b26_videos_iframe", LP.sql([], f"""SELECT page_id, seq, provider, nullif(sr, '') AS src, CASE WHEN {has('sr', '(?i)autoplay=1|autoplay=true')} THEN true WHEN {has('sr', '(?i)autoplay=0')} THEN false END AS autoplay, CASE WHEN {has('sr', '(?i)mute=1|muted=1|muted=true')} THEN true END AS muted FROM
 (SELECT *, {_VPROV} provider FROM (SELECT *, lower(sr) ls FROM (SELECT *, coalesce(nullif({attr('src')}, ''), nullif({attr('data-src')}, ''), nullif({attr('data-video-src')}, ''), '') sr FROM nd WHERE kind = 'open' AND tag IN ('iframe','embed','object'))))
 WHERE NOT {has('sr', H.NOT_VIDEO_FRAME)} AND (provider <> 'unknown' OR {has('sr', H.VIDEO_SRC)})"""))
def _(spark, d):
    return snapshot(spark, d).videos.filter("pass = 2").select("page_id", "seq", "provider", "src", "autoplay", "muted")


@register("b25_b28_videos")
def _(spark, d):
    return snapshot(spark, d).videos.select("page_id", "seq", "pass", "provider", "src", "visible", "controls", "thumbnail")


@register("b32_iframes", LP.sql([], f"SELECT i.page_id, seq, src, title, NOT hidden AS visible, coalesce({D.origin(D.resolve('src', 'url'))} = {D.origin('url')}, false) AS inspectable FROM (SELECT *, coalesce(nullif({attr('src')}, ''), {attr('data-src')}) src, {attr('title')} title FROM nd WHERE kind = 'open' AND tag = 'iframe') i JOIN (SELECT page_id, url FROM lp) u ON u.page_id = i.page_id"))
def _(spark, d):
    return snapshot(spark, d).iframes.select("page_id", "seq", "src", "title", "visible", "inspectable")


@register("b33_embeds", LP.sql([], f"SELECT page_id, seq, tag, coalesce(nullif({attr('src')}, ''), nullif({attr('data-src')}, ''), nullif({attr('data')}, '')) AS src, {attr('title')} AS title, nullif({attr('id')}, '') AS id, NOT hidden AS visible FROM nd WHERE kind IN ('open', 'raw') AND tag IN ('iframe', 'embed', 'object')"))
def _(spark, d):
    return snapshot(spark, d).embeds.select("page_id", "seq", "tag", "src", "title", "id", "visible")


_TM = D.textof("tmx", f"kind = 'open' AND (regexp_matches(coalesce({attr('class')}, ''), 'countdown|timer|clock') OR regexp_matches(coalesce({attr('id')}, ''), 'countdown|timer'))")


@register("b34_timers", LP.sql([], "SELECT page_id, seq, \"text\" AS text, NOT hidden AS visible FROM tmx WHERE \"text\" <> ''", _TM))
def _(spark, d):
    return snapshot(spark, d).timers.select("page_id", "seq", "text", "visible")


@register("b35_dialogs", LP.sql([], "SELECT page_id, seq, \"text\" AS text, NOT hidden AS visible FROM dgx", D.textof("dgx", f"kind = 'open' AND (tag = 'dialog' OR coalesce({attr('role')}, '') = 'dialog' OR regexp_matches(coalesce({attr('class')}, ''), 'modal|popup'))")))
def _(spark, d):
    return snapshot(spark, d).dialogs.select("page_id", "seq", "text", "visible")


@register("b37_vendor_globals", LP.sql(["sc"], f"SELECT DISTINCT page_id, name FROM (SELECT page_id, unnest(regexp_extract_all(inline_snippet, {s(H.GLOBAL_USE)}, 1)) AS name FROM sc WHERE inline_snippet IS NOT NULL) WHERE name IN {lst(H.VENDOR_GLOBALS)}"))
def _(spark, d):
    return snapshot(spark, d).vendor_globals.select("page_id", "name")


@register("b40_page_scalars", LP.sql([], f"SELECT p.page_id, lang, coalesce(title, '') AS title FROM lp p LEFT JOIN (SELECT page_id, arg_min({attr('lang')}, seq) FILTER (WHERE true) lang FROM nd WHERE kind = 'open' AND tag = 'html' GROUP BY 1) l ON l.page_id = p.page_id LEFT JOIN (SELECT page_id, arg_min(\"text\", seq) title FROM ttx GROUP BY 1) t ON t.page_id = p.page_id", D.textof("ttx", "kind = 'open' AND tag = 'title'")))
def _(spark, d):
    return snapshot(spark, d).page.select("page_id", "lang", "title")


@register("b41_completeness")
def _(spark, d):
    return V.completeness(snapshot(spark, d))


@register("b42_html_digest", "SELECT page_id, sha256(html) AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS bytes, length(html) AS characters FROM pages")
def _(spark, d):
    return V.html_digest(spark.read.parquet(f"{d}/pages.parquet"))


@register("b43_b45_raw_html", WEB.sql([], """SELECT page_id, md5(string_agg(CASE WHEN seq < b THEN tok ELSE '' END, '' ORDER BY seq)) AS head, md5(string_agg(CASE WHEN seq >= b THEN tok ELSE '' END, '' ORDER BY seq)) AS body, false AS truncated
FROM (SELECT *, min(CASE WHEN tag = 'body' AND kind = 'open' THEN seq END) OVER (PARTITION BY page_id) b FROM nd) GROUP BY page_id"""))
def _(spark, d):
    doc = web(spark, d)
    return V.raw_html(doc.tokens, doc.pages).select("page_id", F.md5("head").alias("head"), F.md5("body_skeleton").alias("body"), "truncated")


@register("b44_body_skeleton")
def _(spark, d):
    doc = snapshot(spark, d)
    return V.raw_html(doc.nodes.select("page_id", "seq", "tok", "kind", "tag"), doc.pages).select(
        "page_id", F.length("body_skeleton").alias("n"), F.col("body_skeleton").contains("s3cret-token").alias("leak"), F.col("body_skeleton").contains("[elided 14 chars]").alias("noted"))


@register("b46_consent_banners", LP.sql([], "SELECT page_id, seq, \"text\" FROM cbx WHERE NOT hidden AND regexp_matches(\"text\", '(?i)cookie|consent|gdpr|ccpa|personal data|tracking technolog') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY seq) = 1", D.textof("cbx", f"kind = 'open' AND (regexp_matches(lower(coalesce({attr('id')}, '')), 'onetrust|cookiebot|cookie|consent') OR regexp_matches(lower(coalesce({attr('class')}, '')), 'cookie|consent|osano|cmp') OR lower(coalesce({attr('role')}, '')) = 'dialog')")))
def _(spark, d):
    return V.consent_banners(snapshot(spark, d)).select("page_id", "seq", "text")


# =============================================================== scalar functions


@register("c01_c04_normalise", f"SELECT conv_id, turn, {collapse('text')} AS collapsed, {D.norm_label('text')} AS label, {D.norm_msg('text')} AS message, {clip(collapse('text'))} AS clipped, {clip(collapse('text'), 160, 'dots')} AS dots FROM conversations")
def _(spark, d):
    t = spark.read.parquet(f"{d}/conversations.parquet")
    return t.select("conv_id", "turn", T.collapse("text").alias("collapsed"), T.norm_label("text").alias("label"), T.norm_msg("text").alias("message"), T.clip(T.collapse("text")).alias("clipped"), T.clip(T.collapse("text"), 160, "dots").alias("dots"))


_WORDS = f"list_filter(regexp_split_to_array(text, {s(D.WSC + '+')}), lambda w: w <> '')"
_SENTS = f"list_filter(list_transform(regexp_split_to_array(regexp_replace(text, {s('[.!?]+(' + D.WSC + r'|\z)')}, chr(1) || '\\1', 'g'), chr(1)), lambda p: len(list_filter(regexp_split_to_array(p, {s(D.WSC + '+')}), lambda w: w <> ''))), lambda n: n > 0)"
_CHARS = f"list_filter(list_transform({_WORDS}, lambda w: length(regexp_replace(w, {s(r'[^\p{L}\p{N}\x27-]')}, '', 'g'))), lambda n: n > 0)"


@register("c16_c17_copy_metrics", f"SELECT doc_id, len(w) AS word_count, length(text) AS character_count, CASE WHEN len(w) >= 20 THEN floor(list_sum(sn) * 10 / len(sn) + 0.5) / 10 END AS average_sentence_words, CASE WHEN len(w) >= 20 THEN floor(list_sum(ch) * 10 / len(ch) + 0.5) / 10 END AS average_word_characters, length(text) - length(replace(text, '!', '')) AS exclamation_marks, length(text) - length(replace(text, '?', '')) AS question_marks FROM (SELECT doc_id, text, {_WORDS} w, {_SENTS} sn, {_CHARS} ch FROM documents)")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.copy_metrics("text").alias("m")).select("doc_id", "m.*")


@register("c18_all_caps", "SELECT doc_id, i AS line, length(t) AS n FROM (SELECT doc_id, i, trim(ls[i], ' ') t FROM (SELECT doc_id, string_split(text, chr(10)) ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) i FROM documents)) WHERE length(t) >= 8 AND regexp_matches(t, '[A-Za-z]') AND t = upper(t)")
def _(spark, d):
    t = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    return t.filter(T.is_all_caps("t")).select("doc_id", (F.col("i") + 1).cast("long").alias("line"), F.length(T.strip(F.col("t"))).alias("n"))


_SPLIT = "regexp_replace({}, '([.!?])\\s+([^a-z])', '\\1' || chr(1) || '\\2', 'g')"


@register("c19_sentences", f"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array({_SPLIT.format(_SPLIT.format(collapse('text')))}, {s('\x01|\\s*[|•]\\s*')}), lambda x: trim(x, ' ')), lambda x: x <> '')) AS sentences FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.size(T.sentences("text")).alias("sentences"))


@register("c20_c22_prices", f"SELECT doc_id, i, a AS amount, {chain([(f'contains(a, {s(chr(36))}) OR ' + has('a', '(?i)USD'), 'USD'), ('contains(a, ' + s('£') + ') OR ' + has('a', '(?i)GBP'), 'GBP'), ('contains(a, ' + s('€') + ') OR ' + has('a', '(?i)EUR'), 'EUR')])} AS currency FROM (SELECT doc_id, l[i] a, i FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) i FROM (SELECT doc_id, regexp_extract_all(text, {s(P.PRICE)}) l FROM (SELECT doc_id, text || ' Now ' || CAST(n_chars AS VARCHAR) || ' USD or €' || CAST(doc_id AS VARCHAR) || '.50' AS text FROM documents))))")
def _(spark, d):
    t = docs(spark, d).select("doc_id", F.concat("text", F.lit(" Now "), F.col("n_chars").cast("string"), F.lit(" USD or €"), F.col("doc_id").cast("string"), F.lit(".50")).alias("text"))
    return t.select("doc_id", F.posexplode(P.price_tokens("text")).alias("i", "amount")).select("doc_id", (F.col("i") + 1).cast("long").alias("i"), "amount", P.currency("amount").alias("currency"))


@register("c25_month_dates", "SELECT o_orderkey, CAST(month(dt) AS VARCHAR) || '-' || CAST(day(dt) AS VARCHAR) AS date, CASE WHEN o_orderkey % 2 = 0 THEN CAST(year(dt) AS VARCHAR) END AS year FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) dt FROM orders)")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("dt", F.col("o_orderdate").cast("date"))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("dt", "MMMM d, yyyy")).otherwise(F.concat(F.date_format("dt", "d"), F.lit("th "), F.date_format("dt", "MMM")))
    return o.withColumn("p", C.parse_month_date(text)).select("o_orderkey", F.col("p.date").alias("date"), F.col("p.year").alias("year"))


@register("c06_c15_url_functions", f"""SELECT page_id, {D.host('url')} AS host, {D.registrable(D.host('url'))} AS registrable, regexp_replace(url, '#.*$', '') AS no_hash, {D.origin('url')} || {D.upath('url')} AS redacted,
 {D.origin('url')} || CASE WHEN length({D.upath('url')}) > 1 THEN regexp_replace({D.upath('url')}, '/$', '') ELSE {D.upath('url')} END || {D.uquery('url')} AS normalized,
 array_to_string(string_split({D.host('url')}, '.')[-2:], '.') AS root, contains(url, '#') AS hash_only FROM pages""")
def _(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    bare = F.regexp_replace("url", "#.*$", "")
    return p.select("page_id", U.host("url").alias("host"), U.registrable_host(U.host("url")).alias("registrable"), bare.alias("no_hash"), U.redact_url("url").alias("redacted"),
                    U.normalize_url("url").alias("normalized"), U.root_domain(U.host("url")).alias("root"), U.is_hash_only_change(F.col("url"), bare).alias("hash_only"))


@register("c12_canonical_key", f"SELECT page_id, {D.origin('url')} || CASE WHEN length({D.upath('url')}) > 1 THEN regexp_replace({D.upath('url')}, '/+$', '') ELSE '/' END || {D.uquery('url')} AS key FROM pages")
def _(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", U.canonical_key("url").alias("key"))


@register("a11_funnel_ids", f"SELECT page_id, replace(regexp_replace({D.host('url')}, '^www\\.', ''), '.', '-') || '_' || array_to_string(list_filter(list_transform(list_filter(string_split({D.upath('url')}, '/'), lambda x: x <> '')[:2], lambda x: substr(regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40)), lambda x: x <> ''), '_') AS funnel_id FROM pages")
def _(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", U.funnel_id("url").alias("funnel_id"))


@register("c41_emails", f"SELECT doc_id, i, lower(l[i]) AS email FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) i FROM (SELECT doc_id, regexp_extract_all(text, {s(C.EMAIL)}) l FROM documents))")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(C.emails("text")).alias("i", "email")).select("doc_id", (F.col("i") + 1).cast("long").alias("i"), "email")


@register("c41_phones", LP.sql(["vt"], f"""SELECT DISTINCT page_id, trim(p, ' ') AS phone FROM (SELECT page_id, unnest(regexp_extract_all(l, {s(C.PHONE)})) p FROM (SELECT page_id, unnest(string_split(visible_text, chr(10))) l FROM vt)
 WHERE regexp_matches(l, '(?i)\\b(phone|tel|telephone|call us|mobile|whatsapp)\\b')) WHERE length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 7 AND 15"""))
def _(spark, d):
    return snapshot(spark, d).page.select("page_id", F.explode(C.phones("visible_text")).alias("phone")).distinct()


@register("c59_slugify", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def _(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", T.slugify("p_name").alias("slug"))


@register("c60_json_ld_types", LP.sql([], f"SELECT page_id, type FROM (SELECT DISTINCT page_id, unnest(['Answer','FAQPage','Organization','PostalAddress','Question','Review']) AS type FROM nd WHERE kind = 'raw' AND tag = 'script' AND {attr('type')} = 'application/ld+json' AND json_valid({_LDBODY}))"))
def _(spark, d):
    return S.structured_types(detectors(spark, d).json_ld_nodes).select("page_id", "type")


@register("c60_organizations", LP.sql([], f"SELECT page_id, json_extract_string({_LDBODY}, '$.\"@graph\"[0].name') AS name, json_extract_string({_LDBODY}, '$.\"@graph\"[0].address.streetAddress') || ', ' || json_extract_string({_LDBODY}, '$.\"@graph\"[0].address.addressLocality') AS address FROM nd WHERE kind = 'raw' AND tag = 'script' AND {attr('type')} = 'application/ld+json' AND json_valid({_LDBODY})"))
def _(spark, d):
    n = detectors(spark, d).json_ld_nodes
    return S.organization_names(n).select("page_id", "name").join(S.postal_addresses(n).select("page_id", "address"), "page_id")


@register("c49_c57_page_wording", LP.sql(["vt"], f"SELECT page_id, {has('visible_text', L.SCHEDULING_TEXT)} AS scheduling, {has('visible_text', L.BOOKED_TEXT)} AS booked, {has('visible_text', L.CONFIRMATION_TEXT)} AS confirmation, {ext('visible_text', L.TERMINAL_TEXT)} IS NOT NULL AND NOT {has(ext('visible_text', L.TERMINAL_TEXT), L.PROGRESS_TEXT)} AS terminal FROM vt"))
def _(spark, d):
    from pagelode.functions.base import has as h

    t = snapshot(spark, d).texts
    v = "visible_text"
    return t.select("page_id", h(v, L.SCHEDULING_TEXT).alias("scheduling"), h(v, L.BOOKED_TEXT).alias("booked"), L.is_confirmation(v).alias("confirmation"), L.is_terminal_text(v).alias("terminal"))


@register("c55_appointments", LP.sql(["vt"], f"SELECT page_id, coalesce({ext('t', C.APPT_DATE)}, {ext('t', C.APPT_DATE_NUMERIC)}) AS date_text, {ext('t', C.APPT_TIME)} AS time_text, {ext('t', C.APPT_ZONE)} AS timezone, {ext('t', C.APPT_DURATION)} AS duration, nullif(regexp_replace({ext('t', C.APPT_HOST, 1)}, '[.,;:]+$', ''), '') AS host FROM (SELECT page_id, {rep('visible_text', D.WSC + '+', ' ')} t FROM vt)"))
def _(spark, d):
    return snapshot(spark, d).texts.select("page_id", C.appointment("visible_text").alias("a")).select("page_id", "a.*")


# =============================================================== detectors

_CTA = f"""ct0 AS (SELECT *, trim("text", ' ') t FROM bt2),
ct AS MATERIALIZED (SELECT * FROM ct0 WHERE t <> '' AND length(t) <= 120 AND NOT {has('t', L.CTA_IGNORE)} AND (tag = 'button' OR lower(coalesce("type", '')) = 'submit' OR {has('t', L.CTA_HINTS)} OR (visible AND length(t) <= 40 AND {has('t', L.CTA_VERBS)}))
  QUALIFY row_number() OVER (PARTITION BY page_id, lower(t), coalesce(href, ''), y ORDER BY seq) = 1)"""
_SUP = """sup AS (SELECT page_id, seq, string_agg(bt, ' ' ORDER BY i) sc FROM (SELECT c.page_id, c.seq, b."text" bt, row_number() OVER (PARTITION BY c.page_id, c.seq ORDER BY abs(b.y - c.y), b.seq) i FROM ct c JOIN bl b ON b.page_id = c.page_id AND abs(b.y - c.y) < 280 AND b."text" <> c.t) WHERE i <= 2 GROUP BY 1, 2)"""
_CTA_SQL = """SELECT c.page_id, c.seq, c.t AS text, c.href, c.visible, c.position, (SELECT arg_max(h."text", h.y) FROM hd h WHERE h.page_id = c.page_id AND h.y <= c.y) AS headline_above, s.sc AS supporting_copy FROM ct c LEFT JOIN sup s ON s.page_id = c.page_id AND s.seq = c.seq"""


@register("e01_ctas", LP.sql(["bt", "hd_all", "hd", "bl"], _CTA_SQL, _CTA + "," + _SUP))
def _(spark, d):
    return detectors(spark, d).ctas.select("page_id", "seq", "text", "href", "visible", "position", "headline_above", "supporting_copy")


@register("e01_stated_outcome")
def _(spark, d):
    return detectors(spark, d).ctas.select("page_id", "seq", "text", "section", "stated_outcome")


@register("e02_g09_forms")
def _(spark, d):
    return detectors(spark, d).classified_forms.select("page_id", "seq", "form_type", "field_count", "required_count", "contact_fields_position", "multi_step", "burden", F.array_join("question_types", ",").alias("question_types"))


@register("g10_primary_friction")
def _(spark, d):
    return detectors(spark, d).friction.select("page_id", "seq", "form_type", "field_count", "burden")


_TB = """tb AS MATERIALIZED (SELECT page_id, 0 AS rank, seq, "text", visible, position, y FROM hd UNION ALL SELECT page_id, 1, seq, "text", visible, position, y FROM bl),
tbb AS (SELECT * FROM tb UNION ALL SELECT page_id, 2, seq, "text", visible, position, y FROM bt2)"""
_NONPRICE = f"""((regexp_matches("text", {s(P.NOT_A_PRICE)}) AND NOT contains(a, '$')) OR (coalesce(TRY_CAST(regexp_replace(a, '[^0-9.]', '', 'g') AS DOUBLE) > 0 AND TRY_CAST(regexp_replace(a, '[^0-9.]', '', 'g') AS DOUBLE) < 2, false) AND NOT regexp_matches(a, '[.][0-9]{{2}}')))"""


@register("e04_pricing", LP.sql(["hd_all", "hd", "bl", "bt"], f"""SELECT page_id, seq, a AS amount, {ext('"text"', P.ORIGINAL_PRICE, 1)} AS original_price, position FROM (
 SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank, seq, i) rn FROM (SELECT * FROM (SELECT *, l[i] a FROM (SELECT *, unnest(range(1, len(l) + 1)) i FROM (SELECT *, regexp_extract_all("text", {s(P.PRICE)}) l FROM tbb))) WHERE NOT {_NONPRICE}
 QUALIFY row_number() OVER (PARTITION BY page_id, a, "text" ORDER BY rank, seq, i) = 1))""", _TB))
def _(spark, d):
    return detectors(spark, d).pricing.select("page_id", "seq", "amount", "original_price", "position")


_TST = f"""tq AS (SELECT page_id, 0 AS pass, 0 AS h_seq, seq, "text", position, y FROM bl WHERE regexp_matches(trim("text", ' '), '^["“'']') AND length(trim("text", ' ')) BETWEEN 41 AND 799),
tu AS (SELECT h.page_id, 1 AS pass, h.seq h_seq, b.seq, b."text", b.position, b.y FROM hd h JOIN bl b ON b.page_id = h.page_id AND b.y >= h.y AND b.y < h.y + 900 AND length(b."text") > 40 WHERE {has('h."text"', C.TESTIMONIAL_HEADINGS)}),
te AS (SELECT * FROM (SELECT * FROM tq UNION ALL SELECT * FROM tu) QUALIFY row_number() OVER (PARTITION BY page_id, "text" ORDER BY pass, h_seq, seq) = 1),
tt AS MATERIALIZED (SELECT * FROM te WHERE NOT ({has('"text"', C.PROBLEM_STATEMENT)} AND NOT {has('"text"', C.RESULT)}))"""


@register("e05_testimonials", LP.sql(["hd_all", "hd", "bl"], f"SELECT page_id, seq, \"text\", position, CASE WHEN {has('\"text\"', C.RESULT)} THEN trim({ext('\"text\"', C.CLAIMED_RESULT, 1)}, ' ') END AS claimed_result, pass = 1 AS under_heading FROM tt", _TST))
def _(spark, d):
    return detectors(spark, d).testimonials.select("page_id", "seq", "text", "position", "claimed_result", (F.col("format") == "section_under_heading").alias("under_heading"))


@register("e06_social_proof")
def _(spark, d):
    return detectors(spark, d).social_proof.select("page_id", "part", "i", "kind", "text", "position")


_UK = " UNION ALL ".join(f"SELECT page_id, rank, seq, {i} AS k, {s(k)} AS kind, {str(c).lower()} AS concrete, \"text\", position, lower(regexp_extract(\"text\", {s(p)}, 0)) m FROM tbb WHERE {has('\"text\"', p)}" for i, (k, p, c) in enumerate(C.URGENCY_KINDS))


@register("e07_urgency", LP.sql(["hd_all", "hd", "bl", "bt"], f"SELECT page_id, kind, concrete AS concrete_deadline_visible, \"text\" AS text, position FROM ({_UK}) QUALIFY row_number() OVER (PARTITION BY page_id, kind, m ORDER BY rank, seq, k) = 1 UNION ALL SELECT page_id, 'countdown_timer', regexp_matches(t, '[0-9]'), t, CASE WHEN seq * 10 < 900 THEN 'above_fold' ELSE 'below_fold' END FROM (SELECT page_id, seq, \"text\" t FROM tmx WHERE \"text\" <> '') QUALIFY row_number() OVER (PARTITION BY page_id, t ORDER BY seq) = 1", _TB + "," + _TM))
def _(spark, d):
    return detectors(spark, d).urgency.select("page_id", "kind", "concrete_deadline_visible", "text", "position")


@register("e08_faqs")
def _(spark, d):
    return detectors(spark, d).faqs.select("page_id", "heading", "question", "answer", "source")


@register("e09_benefits", LP.sql(["hd_all", "hd", "bl"], f"""SELECT page_id, h_seq, seq, t AS text FROM (SELECT *, max(CASE WHEN listy THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, h_seq) sm FROM (
 SELECT h.page_id, h.seq h_seq, b.seq, b."text" t, length(b."text") < 240 OR regexp_matches(b."text", '^[-•*]') OR regexp_matches(b."text", '^[0-9]+[).]') listy FROM
 (SELECT x.page_id, x.seq, x.y, coalesce((SELECT arg_min(o.y, o.seq) FROM hd o WHERE o.page_id = x.page_id AND o.y > x.y AND o.level <= x.level), x.y + 800) b FROM hd x WHERE {has('x."text"', C.BENEFIT_HEADINGS)}) h JOIN bl b ON b.page_id = h.page_id AND b.y >= h.y AND b.y < h.b AND length(b."text") > 12))
 WHERE listy OR sm = 0"""))
def _(spark, d):
    return detectors(spark, d).benefits.filter("kind = 'benefit_or_takeaway'").select("page_id", "h_seq", "seq", "text")


_OBJ = " UNION ALL ".join(f"SELECT page_id, rank, seq, {s(k)} AS topic, \"text\", position, \"text\" key FROM tb WHERE {has('\"text\"', p)}" for k, p in C.OBJECTION_TOPICS)


@register("e10_objections", LP.sql(["hd_all", "hd", "bl"], f"SELECT page_id, topic, \"text\" AS text, position FROM (SELECT o.*, row_number() OVER (PARTITION BY page_id, topic, key ORDER BY rank, seq) rn, min(CASE WHEN topic = 'price' THEN rank * 1000000 + seq END) OVER (PARTITION BY page_id, key) pr FROM ({_OBJ}) o) WHERE rn = 1 AND (topic <> 'price_mention' OR pr IS NULL OR pr > rank * 1000000 + seq)", _TB))
def _(spark, d):
    return detectors(spark, d).objections.select("page_id", "topic", "text", "position")


@register("e11_bonuses", LP.sql(["hd_all", "hd", "bl"], f"SELECT page_id, kind, \"text\" AS text FROM (SELECT *, {chain([(has('\"text\"', p), k) for k, p in C.BONUS_KINDS])} kind FROM tb) WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id, \"text\" ORDER BY rank, seq) = 1", _TB))
def _(spark, d):
    return detectors(spark, d).bonuses.select("page_id", "kind", "text")


_SE = f"""se AS MATERIALIZED (SELECT page_id, rank, seq, i, trim(l[i], ' ') x FROM (SELECT *, unnest(range(1, len(l) + 1)) i FROM (SELECT page_id, rank, seq, regexp_split_to_array({_SPLIT.format(_SPLIT.format(collapse('"text"')))}, {s('\x01|\\s*[|•]\\s*')}) l FROM tb WHERE visible)) WHERE trim(l[i], ' ') <> '')"""
_GK = chain([(has("x", p), k) for k, p in C.GUARANTEE_KINDS])
_GP = "CASE kind " + " ".join(f"WHEN {s(k)} THEN [regexp_extract(x, {s('(?s)^(.*?)' + p)}, 1), regexp_extract(x, {s(p)}, 0)]" for k, p in C.GUARANTEE_KINDS) + " END"
_BEFORE = C.NEGATOR_BEFORE


@register("e12_guarantees", LP.sql(["hd_all", "hd", "bl"], f"""SELECT page_id, kind, {clip('x', 240)} AS text, {ext('x', C.DURATION)} AS duration FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank, seq, i) rn FROM (SELECT * FROM (SELECT *, {_GP} g FROM (SELECT *, {_GK} kind FROM se) WHERE kind IS NOT NULL)
 WHERE NOT {has('x', C.POLICY_LABEL)} AND NOT {has('x', C.NEGATED_PHRASE)} AND NOT {has('g[1]', _BEFORE)} AND NOT {has('substr(x, length(g[1]) + length(g[2]) + 1)', C.NEGATOR_AFTER)} AND NOT ({has('x', C.POLICY_REFERENCE)} AND NOT {has('x', C.PROMISE)} AND NOT {has('x', C.DURATION)})
 QUALIFY row_number() OVER (PARTITION BY page_id, lower(x) ORDER BY rank, seq, i) = 1))""", _TB + "," + _SE))
def _(spark, d):
    return detectors(spark, d).guarantees.select("page_id", "kind", "text", "duration")


@register("e23_deadlines", LP.sql(["hd_all", "hd", "bl"], f"SELECT page_id, {clip('x', 240)} AS text, {ext('x', C.DATE_TEXT)} AS date_text FROM (SELECT * FROM se WHERE {has('x', C.CLOSING_VERB)} AND {has('x', C.DATE_TEXT)} QUALIFY row_number() OVER (PARTITION BY page_id, lower(x) ORDER BY rank, seq, i) = 1)", _TB + "," + _SE))
def _(spark, d):
    return detectors(spark, d).deadlines.select("page_id", "text", "date_text")


@register("e23_scarcity", LP.sql(["hd_all", "hd", "bl"], f"SELECT page_id, kind, {clip('x', 240)} AS text FROM (SELECT * FROM (SELECT *, {chain([(has('x', p), k) for k, p in C.SCARCITY_KINDS])} kind FROM se) WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id, kind, lower(x) ORDER BY rank, seq, i) = 1)", _TB + "," + _SE))
def _(spark, d):
    return detectors(spark, d).scarcity.select("page_id", "kind", "text")


_VH = " UNION ALL ".join(f"SELECT page_id, {s(v)} AS vendor, {s(k)} AS kind FROM sc WHERE " + " OR ".join(([has("src", h), has("host", h)] if h else []) + ([has("inline_snippet", i)] if i else [])) for v, k, h, i, g in H.VENDORS if h or i)
_VG = " UNION ALL ".join(f"SELECT page_id, {s(v)}, {s(k)} FROM gl WHERE regexp_matches(name, {s(g)})" for v, k, h, i, g in H.VENDORS if g)
_GL = f"gl AS (SELECT DISTINCT page_id, name FROM (SELECT page_id, unnest(regexp_extract_all(inline_snippet, {s(H.GLOBAL_USE)}, 1)) AS name FROM sc WHERE inline_snippet IS NOT NULL) WHERE name IN {lst(H.VENDOR_GLOBALS)})"


@register("e19_tracking", LP.sql(["sc"], f"SELECT DISTINCT page_id, vendor, kind FROM ({_VH} UNION ALL {_VG})", _GL))
def _(spark, d):
    return detectors(spark, d).tracking.select("page_id", "vendor", "kind")


@register("e20_third_party_hosts", LP.sql(["sc"], f"SELECT page_id, array_to_string(list_sort(list(DISTINCT host)), ',') AS hosts FROM sc WHERE host IS NOT NULL AND host <> {D.host('url')} GROUP BY page_id"))
def _(spark, d):
    return detectors(spark, d).third_party_hosts.select("page_id", F.array_join("hosts", ",").alias("hosts"))


_IDS = " UNION ALL ".join(f"SELECT page_id, {s(sl)} AS slug, unnest(regexp_extract_all(p, {s(pt)}, {g})) AS id FROM pc" + (f" WHERE {has('p', rq)}" if rq else "") for sl, pt, g, rq in H.ID_PATTERNS)


@register("e21_vendor_ids", LP.sql(["sc"], f"SELECT DISTINCT page_id, slug, id FROM ({_IDS})", "pc AS (SELECT page_id, src p FROM sc WHERE coalesce(src, '') <> '' UNION ALL SELECT page_id, inline_snippet FROM sc WHERE inline_snippet IS NOT NULL)"))
def _(spark, d):
    return detectors(spark, d).vendor_ids.select("page_id", "slug", "id")


@register("e13_oto")
def _(spark, d):
    return detectors(spark, d).oto.select("page_id", "detected", "price", "discount", "cta_text", "countdown", F.array_join("evidence", "|").alias("evidence"))


@register("e14_page_types")
def _(spark, d):
    return detectors(spark, d).page_types.select("page_id", "page_type", "confidence", F.array_join("evidence", "|").alias("evidence"))


@register("e15_g22_funnel_types")
def _(spark, d):
    return sections(spark, d).funnel.select("page_id", "status", "funnel_type", "confidence", F.array_join("evidence", "|").alias("evidence"), "reason")


@register("e16_goals")
def _(spark, d):
    return sections(spark, d).goals.select("page_id", "status", "goal", "confidence")


@register("e17_brands")
def _(spark, d):
    return K.brand_names(detectors(spark, d)).select("page_id", "status", "brand", "confidence")


@register("e22_vsl")
def _(spark, d):
    return sections(spark, d).vsl


@register("e24_social_proof_section")
def _(spark, d):
    return sections(spark, d).proof.select("page_id", "family", "kind", "text", "value", "position")


@register("e25_e26_form_entries")
def _(spark, d):
    return sections(spark, d).forms.select("page_id", "index", "provider", "integration", "above_fold", "field_count", "destination_kind", "destination_host")


@register("e33_inconsistencies")
def _(spark, d):
    return sections(spark, d).inconsistencies


@register("e34_deliverables")
def _(spark, d):
    return sections(spark, d).deliverables


@register("e35_offer")
def _(spark, d):
    return sections(spark, d).offer.select("page_id", "product", "audience", "mechanism", "clarity", F.array_join("missing", ",").alias("missing"))


@register("e37_g02_navigation")
def _(spark, d):
    return sections(spark, d).navigation


# =============================================================== aggregates and windows

_LK = f"""lk AS (SELECT *, trim(href, ' ') r, {D.scheme("trim(href, ' ')")} sch FROM ln WHERE trim(coalesce(href, ''), ' ') <> ''),
lk2 AS (SELECT *, {D.host('r')} h, sch IN ('http','https') AND contains(r, '#') AND regexp_extract(r, '#(.*)$', 1) <> '' AND {D.docurl('r')} = {D.docurl('url')} anc FROM lk),
lk3 AS (SELECT *, sch IN ('http','https') AND NOT anc AND {D.registrable('h')} = {D.registrable(D.host('url'))} ins FROM lk2)"""


@register("g01_links", LP.sql(["ln"], """SELECT page_id, count(*) AS total, count(DISTINCT r) AS "unique", count(*) FILTER (WHERE ins) AS internal, count(*) FILTER (WHERE sch IN ('http','https') AND NOT anc AND NOT ins) AS external, count(*) FILTER (WHERE anc) AS anchors,
 coalesce(array_to_string(list_sort(list(DISTINCT h) FILTER (WHERE sch IN ('http','https') AND NOT anc AND NOT ins)), ','), '') AS external_hosts FROM lk3 GROUP BY page_id""", _LK))
def _(spark, d):
    return sections(spark, d).links.select("page_id", "total", "unique", "internal", "external", "anchors", F.array_join("external_hosts", ",").alias("external_hosts"))


@register("g01_links_web", WEB.sql(["ln"], """SELECT page_id, count(*) AS total, count(DISTINCT r) AS "unique", count(*) FILTER (WHERE ins) AS internal, count(*) FILTER (WHERE sch IN ('http','https') AND NOT anc AND NOT ins) AS external FROM lk3 GROUP BY page_id""", _LK))
def _(spark, d):
    return web_sections(spark, d).links.filter("total > 0").select("page_id", "total", "unique", "internal", "external")


@register("g05_cta_consistency")
def _(spark, d):
    return sections(spark, d).cta_consistency.select("page_id", "consistent", "distinct_labels", "confidence")


@register("g04_g12_cta_totals")
def _(spark, d):
    return sections(spark, d).cta_totals.select("page_id", "ctas", "ctas_above", "primary_text", "unique_destinations", "histogram")


@register("i08_i09_ctas")
def _(spark, d):
    return sections(spark, d).ctas.select("page_id", "index", "text", "type", "kind", "url", "host", "provider", "anchor", "is_primary", "form_index")


@register("g06_repeated_messages", LP.sql(["hd_all", "hd", "bl"], f"SELECT page_id, {clip(collapse('t'), 160, 'dots')} AS text, n AS occurrences FROM (SELECT page_id, k, count(*) n, min(rank * 1000000 + seq) f, arg_min(\"text\", rank * 1000000 + seq) t FROM (SELECT *, {D.norm_msg('\"text\"')} k FROM tb WHERE visible) WHERE length(k) >= 15 GROUP BY 1, 2 HAVING count(*) >= 2)", _TB))
def _(spark, d):
    return sections(spark, d).repeated_messages.drop("i")


_KEY = f"""tp AS (SELECT page_id, seq, level, y, trim("text", ' ') t FROM hd WHERE level <= 2 AND visible),
ld AS (SELECT tp.page_id, tp.seq, arg_min(b.t, b.seq) t FROM (SELECT page_id, seq, y, trim("text", ' ') t FROM bl WHERE visible AND length(trim("text", ' ')) >= 41) b ASOF JOIN tp ON b.page_id = tp.page_id AND b.y >= tp.y GROUP BY 1, 2),
cm AS (SELECT page_id, p, seq, t, {D.norm_msg('t')} k FROM (SELECT page_id, 0 p, seq, t FROM tp WHERE level = 1 UNION ALL SELECT page_id, 1, seq, t FROM tp UNION ALL SELECT page_id, 2, seq, t FROM ld))"""


@register("h12_key_messages", LP.sql(["hd_all", "hd", "bl"], """SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY p, seq) - 1 AS INTEGER) AS i, t AS text FROM (SELECT * FROM cm WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY page_id, k ORDER BY p, seq) = 1)""", _KEY))
def _(spark, d):
    return sections(spark, d).key_messages


@register("h12_above_fold_copy", LP.sql(["hd_all", "hd", "bl"], f"SELECT page_id, t AS text FROM (SELECT *, trim(\"text\", ' ') t, {D.norm_msg('\"text\"')} k FROM tb WHERE visible AND position = 'above_fold' QUALIFY k <> '' AND row_number() OVER (PARTITION BY page_id, k ORDER BY y, rank, seq) = 1)", _TB))
def _(spark, d):
    return sections(spark, d).above_fold_copy.drop("i")


@register("h02_skipped_levels", LP.sql(["hd_all", "hd"], "SELECT page_id, array_to_string(list_sort(list(DISTINCT l)), ',') AS skipped_levels FROM (SELECT page_id, unnest(range(p + 1, level)) l FROM (SELECT page_id, level, lag(level) OVER (PARTITION BY page_id ORDER BY seq) p FROM hd) WHERE level > p + 1) GROUP BY page_id"))
def _(spark, d):
    return sections(spark, d).skipped_levels.filter("skipped_levels IS NOT NULL").select("page_id", F.array_join(F.transform("skipped_levels", lambda x: x.cast("string")), ",").alias("skipped_levels"))


@register("g07_pricing")
def _(spark, d):
    return sections(spark, d).pricing.select("page_id", "price_count", "currency", "lowest", "highest", "pricing_cta", F.array_join("payment_plans", "|").alias("payment_plans"))


@register("i15_prices")
def _(spark, d):
    return sections(spark, d).prices.select("page_id", "seq", "i", "amount", "numeric_amount", "currency", "discount", "recurring", "payment_plan")


@register("g08_seo", LP.sql(["hd_all", "hd", "im"], "SELECT p.page_id, coalesce(h1, 0) AS h1_count, coalesce(h1v, 0) AS h1_visible, coalesce(n, 0) AS headings, coalesce(ord, '') AS heading_order, coalesce(im.t, 0) AS images, coalesce(im.m, 0) AS missing_alt FROM lp p LEFT JOIN (SELECT page_id, count(*) FILTER (WHERE level = 1) h1, count(*) FILTER (WHERE level = 1 AND visible) h1v, count(*) n, string_agg(CAST(level AS VARCHAR), ',' ORDER BY seq) ord FROM hd GROUP BY 1) h ON h.page_id = p.page_id LEFT JOIN (SELECT page_id, count(*) t, count(*) FILTER (WHERE visible AND trim(coalesce(alt, ''), ' ') = '') m FROM im GROUP BY 1) im ON im.page_id = p.page_id"))
def _(spark, d):
    return sections(spark, d).seo.select("page_id", "h1_count", "h1_visible", "headings", F.coalesce("heading_order", F.lit("")).alias("heading_order"), "images", "missing_alt")


@register("i20_seo_flags")
def _(spark, d):
    return sections(spark, d).seo.select("page_id", "title", "canonical", "self_referential", "robots", "indexable", "starts_with_h1", "structured_count", "parse_errors")


@register("i05_copy")
def _(spark, d):
    return sections(spark, d).copy


@register("i06_f21_videos")
def _(spark, d):
    return sections(spark, d).videos.select("page_id", "index", "provider", "src", "video_id", "above_fold")


@register("g11_video_totals")
def _(spark, d):
    return sections(spark, d).video_totals


@register("i11_testimonials")
def _(spark, d):
    return sections(spark, d).testimonials.select("page_id", "index", "name", "role", "company", "rating", "result_claim", "format", "source")


@register("g16_proof_totals")
def _(spark, d):
    return sections(spark, d).proof_totals


_URG = f"""dl AS (SELECT page_id, {clip('x', 240)} t FROM (SELECT * FROM se WHERE {has('x', C.CLOSING_VERB)} AND {has('x', C.DATE_TEXT)} QUALIFY row_number() OVER (PARTITION BY page_id, lower(x) ORDER BY rank, seq, i) = 1)),
sq AS (SELECT page_id, kind, {clip('x', 240)} t FROM (SELECT *, {chain([(has('x', p), k) for k, p in C.SCARCITY_KINDS])} kind FROM se) WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id, kind, lower(x) ORDER BY rank, seq, i) = 1),
un AS (SELECT lp.page_id, coalesce(a.n, 0) timers, coalesce(a.r, 0) running, coalesce(b.n, 0) deadlines, coalesce(b.r, 0) dated, coalesce(c.n, 0) scarcity, coalesce(c.r, 0) counted FROM lp
 LEFT JOIN (SELECT page_id, count(*) n, count(*) FILTER (WHERE NOT hidden) r FROM tmx WHERE "text" <> '' AND {has('"text"', C.TIMER_TEXT)} GROUP BY 1) a ON a.page_id = lp.page_id
 LEFT JOIN (SELECT page_id, count(*) n, count(*) FILTER (WHERE {has('t', C.CONCRETE_DATE)}) r FROM dl GROUP BY 1) b ON b.page_id = lp.page_id
 LEFT JOIN (SELECT page_id, count(*) n, count(*) FILTER (WHERE kind IN ('limited_spots', 'limited_bonus') AND regexp_matches(t, '\\b[0-9]{{1,4}}\\b')) r FROM sq GROUP BY 1) c ON c.page_id = lp.page_id)"""


@register("i16_urgency", LP.sql(["hd_all", "hd", "bl"], """SELECT page_id, running + dated + counted + deadlines + scarcity > 0 AS detected,
 CASE WHEN running + dated + counted > 0 THEN 'explicit' WHEN deadlines + scarcity > 0 THEN 'language_only' ELSE 'none' END AS evidence_quality, timers, deadlines, scarcity FROM un""", _TB + "," + _SE + "," + _TM + "," + _URG))
def _(spark, d):
    return sections(spark, d).urgency


@register("g20_tracking_totals")
def _(spark, d):
    return sections(spark, d).tracking_totals.drop("hosts")


@register("i25_context")
def _(spark, d):
    return sections(spark, d).context.select("page_id", "conversion_path", "has_form", "form_above_fold", "conversion_in_view", "page_rendered", "checkout_signal", "expects_price", "expects_proof", "label")


@register("l05_g17_link_candidates", LP.sql(["ln"], f"SELECT page_id, count(*) FILTER (WHERE r IS NULL) AS checked, count(*) FILTER (WHERE r IS NOT NULL) AS skipped FROM (SELECT *, sum(CASE WHEN r IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY seq) n FROM (SELECT page_id, u, min(seq) seq, CASE WHEN NOT bool_or(visible) THEN 'hidden' END r FROM (SELECT *, regexp_replace(href, '#.*$', '') u FROM ln WHERE trim(coalesce(href, ''), ' ') <> '') WHERE regexp_matches(u, '^https?://') AND trim(raw_href, ' ')[1] <> '#' GROUP BY 1, 2)) GROUP BY page_id"))
def _(spark, d):
    doc = snapshot(spark, d)
    return LC.summary(LC.candidates(doc.links, doc.base)).select("page_id", "checked", F.col("skipped").cast("long").alias("skipped"))


# =============================================================== rules

_SIMPLE = ["NOINDEX_DETECTED", "NOT_HTTPS", "MISSING_H1", "MISSING_TITLE", "MISSING_VIEWPORT_META", "BROKEN_HEADING_HIERARCHY", "IMAGES_MISSING_ALT", "MISSING_CANONICAL", "MISSING_META_DESCRIPTION", "MULTIPLE_H1", "NO_ANALYTICS_DETECTED", "NO_ADVERTISING_PIXEL_DETECTED"]
_TT = D.textof("ttx", "kind = 'open' AND tag = 'title'")
_CAT = {v: ("attribution" if v in H.VENDOR_CATEGORIES else "advertising_pixel" if k == "pixel" else k) for v, k, *_ in H.VENDORS}


def _rules_sql(ctx):
    rows = f"""m AS (SELECT page_id, {_first("name = 'description'", 'content')} AS description, {_first("name = 'robots'", 'content')} AS robots, bool_or(name = 'viewport') vp FROM ({_META}) GROUP BY page_id),
cn AS (SELECT page_id, nullif(arg_min(coalesce({attr('href')}, ''), seq), '') canonical FROM nd WHERE kind = 'open' AND tag = 'link' AND {attr('rel')} = 'canonical' GROUP BY page_id),
h1 AS (SELECT page_id, count(*) n FROM hd WHERE level = 1 AND visible GROUP BY 1), sk AS (SELECT DISTINCT page_id FROM (SELECT page_id, level, lag(level) OVER (PARTITION BY page_id ORDER BY seq) p FROM hd WHERE visible) WHERE level > p + 1),
al AS (SELECT page_id, count(*) n FROM im WHERE visible AND trim(coalesce(alt, ''), ' ') = '' GROUP BY 1), ti AS (SELECT page_id, arg_min("text", seq) title FROM ttx GROUP BY 1),
vd AS (SELECT DISTINCT page_id, vendor FROM ({_VH} UNION ALL {_VG})), an AS (SELECT DISTINCT page_id FROM vd WHERE vendor IN {lst([v for v, c in _CAT.items() if c == 'analytics'])}), px AS (SELECT DISTINCT page_id FROM vd WHERE vendor IN {lst([v for v, c in _CAT.items() if c == 'advertising_pixel'])})"""
    cases = {
        "NOINDEX_DETECTED": ("regexp_matches(coalesce(robots, ''), '(?i)\\bnoindex\\b')", "critical"), "NOT_HTTPS": ("url LIKE 'http://%'", "critical"), "MISSING_H1": ("coalesce(h1.n, 0) = 0", "medium"),
        "MISSING_TITLE": ("coalesce(title, '') = ''", "medium"), "MISSING_VIEWPORT_META": ("NOT coalesce(vp, false)", "medium"), "BROKEN_HEADING_HIERARCHY": ("sk.page_id IS NOT NULL", "informational"), "IMAGES_MISSING_ALT": ("coalesce(al.n, 0) >= 5", "low"),
        "MISSING_CANONICAL": ("canonical IS NULL", "low"), "MISSING_META_DESCRIPTION": ("description IS NULL", "low"), "MULTIPLE_H1": ("coalesce(h1.n, 0) >= 2", "low"), "NO_ANALYTICS_DETECTED": ("an.page_id IS NULL", None), "NO_ADVERTISING_PIXEL_DETECTED": ("px.page_id IS NULL", "medium")}
    base = "FROM lp p LEFT JOIN m ON m.page_id = p.page_id LEFT JOIN cn ON cn.page_id = p.page_id LEFT JOIN h1 ON h1.page_id = p.page_id LEFT JOIN sk ON sk.page_id = p.page_id LEFT JOIN al ON al.page_id = p.page_id LEFT JOIN ti ON ti.page_id = p.page_id LEFT JOIN an ON an.page_id = p.page_id LEFT JOIN px ON px.page_id = p.page_id"
    tail = " UNION ALL ".join(f"SELECT p.page_id, {s(i)} AS id, {s(sv) if sv else 'CAST(NULL AS VARCHAR)'} AS severity {base} WHERE {c}" for i, (c, sv) in cases.items())
    return ctx.sql(["hd_all", "hd", "im", "sc"], tail, _GL + "," + _TT + "," + rows)


def _found(sec):
    t = R.issues(sec).filter(F.col("id").isin(_SIMPLE))
    return t.select("page_id", "id", F.when(F.col("id") != "NO_ANALYTICS_DETECTED", F.col("severity")).alias("severity"))


@register("j03_j26_markup_rules", _rules_sql(LP))
def _(spark, d):
    return _found(sections(spark, d))


@register("j03_j26_markup_rules_web", _rules_sql(WEB))
def _(spark, d):
    return _found(web_sections(spark, d))


@register("j01_j30_issues")
def _(spark, d):
    return R.issues(sections(spark, d)).select("page_id", "id", "severity", "category", "confidence", F.array_join("evidence", " | ").alias("evidence"))


@register("g13_issues_by_severity")
def _(spark, d):
    sec = web_sections(spark, d)
    return R.issue_counts(R.issues(sec), sec.doc.base)


# =============================================================== corpus


@register("k01_issue_rollup")
def _(spark, d):
    sec = web_sections(spark, d)
    return CO.issue_rollup(R.issues(sec), sec.doc.pages, "root_domain")


@register("k02_issue_cube")
def _(spark, d):
    return CO.issue_cube(R.issues(sections(spark, d)))


@register("k03_vendor_adoption", LP.sql(["sc"], f"SELECT vendor, count(DISTINCT {D.host('url')}) AS hosts, count(*) AS pages FROM (SELECT DISTINCT v.page_id, vendor, url FROM ({_VH} UNION ALL {_VG}) v JOIN lp ON lp.page_id = v.page_id) GROUP BY vendor", _GL))
def _(spark, d):
    sec = sections(spark, d)
    return CO.vendor_adoption(sec.tracking, sec.doc.pages).select("vendor", "hosts", "pages")


@register("k04_shared_messages", LP.sql(["hd_all", "hd", "bl"], f"SELECT host, message, count(*) AS pages FROM (SELECT DISTINCT t.page_id, {D.norm_msg('\"text\"')} AS message, {D.host('url')} AS host FROM tb t JOIN lp ON lp.page_id = t.page_id) WHERE length(message) >= 15 GROUP BY 1, 2 HAVING count(*) >= 2", _TB))
def _(spark, d):
    det = detectors(spark, d)
    return CO.shared_messages(det.copy, det.doc.pages)


@register("k05_duplicate_pages", "SELECT sha256(html) AS sha256, count(*) AS copies, min(page_id) AS first_page FROM (SELECT doc_id AS page_id, text AS html FROM documents) GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return CO.duplicate_pages(docs(spark, d).select(F.col("doc_id").alias("page_id"), F.col("text").alias("html")))


@register("k07_link_edges", LP.sql(["ln"], f"SELECT {D.host('url')} AS src_host, {D.host('href')} AS dst_host, count(*) AS links, {D.registrable(D.host('url'))} = {D.registrable(D.host('href'))} AS internal FROM ln WHERE {D.host('href')} IS NOT NULL GROUP BY ALL"))
def _(spark, d):
    doc = snapshot(spark, d)
    return CO.link_edges(doc.links, doc.base)


@register("k07_link_edges_web", WEB.sql(["ln"], f"SELECT {D.host('url')} AS src_host, {D.host('href')} AS dst_host, count(*) AS links, {D.registrable(D.host('url'))} = {D.registrable(D.host('href'))} AS internal FROM ln WHERE {D.host('href')} IS NOT NULL GROUP BY ALL"))
def _(spark, d):
    doc = web(spark, d)
    return CO.link_edges(doc.links, doc.base)


@register("k08_coverage")
def _(spark, d):
    return CO.coverage(V.completeness(snapshot(spark, d)))


# =============================================================== funnel runs


def run_roles(det):
    """Every page is one step of a run of four: landing, form, intermediate, confirmation."""
    k = F.col("page_id") % 4
    role = F.when(k == 0, "landing").when(k == 1, "form").when(k == 2, "intermediate").otherwise("confirmation")
    return det.doc.base.select("page_id", F.floor(F.col("page_id") / 4).alias("run_id"), k.cast("int").alias("sequence"), role.alias("role"))


@register("j31_j37_role_issues")
def _(spark, d):
    sec = sections(spark, d)
    return RO.role_issues(RO.role_row(sec, run_roles(sec.det))).drop("rank")


@register("j38_recommendations")
def _(spark, d):
    sec = sections(spark, d)
    return RO.recommendations(RO.role_issues(RO.role_row(sec, run_roles(sec.det))))


@register("e28_scheduling_presence")
def _(spark, d):
    return RO.scheduling_presence(sections(spark, d))


@register("e31_confirmation_details")
def _(spark, d):
    t = RO.confirmation_details(sections(spark, d))
    return t.withColumn("next_steps", F.array_join("next_steps", "|")).withColumn("upsells", F.array_join("upsells", "|")).withColumn("calendar_links", F.array_join("calendar_links", "|"))


@register("i29_business_names")
def _(spark, d):
    return RO.business_names(sections(spark, d))


@register("g23_form_inventory")
def _(spark, d):
    sec = sections(spark, d)
    return RO.form_inventory(sec, run_roles(sec.det))


@register("i28_g24_run_dataset")
def _(spark, d):
    sec = sections(spark, d)
    t = RO.run_dataset(sec, run_roles(sec.det), RO.role_issues(RO.role_row(sec, run_roles(sec.det))))
    return t.select("run_id", "landing_captured", "confirmation_captured", *[F.size(c).alias(c) for c in ("pages", "forms", "issues", "price_points", "proof_points", "audience_signals", "limitations")])


@register("g26_page_navigation", LP.sql(["ln"], "SELECT page_id, count(*) AS total_links, count(*) FILTER (WHERE in_nav AND visible) AS nav_links, count(*) FILTER (WHERE contains(href, '#')) AS anchor_links FROM ln GROUP BY page_id"))
def _(spark, d):
    return RO.page_navigation(sections(spark, d)).select("page_id", "total_links", "nav_links", "anchor_links")


@register("i26_compose")
def _(spark, d):
    t = compose(sections(spark, d))
    return t.select("page_id", *[F.md5(F.to_json(c)).alias(c) for c in t.columns if c != "page_id"])


# =============================================================== event logs

_LOG = "SELECT event_id, user_id AS page_id, ts, CASE event_type WHEN 'error' THEN 'requestfailed' WHEN 'view' THEN 'response' ELSE 'request' END AS kind, 'https://cdn' || CAST(event_id % 7 AS {t}) || '.example.com/a.js' AS url, CASE WHEN event_type = 'view' THEN 200 + 100 * CAST(event_id % 4 AS INT) END AS status FROM "


def _log(spark, d):
    e = events(spark, d)
    return e.select("event_id", F.col("user_id").alias("page_id"), "ts", F.when(F.col("event_type") == "error", "requestfailed").when(F.col("event_type") == "view", "response").otherwise("request").alias("kind"),
                    F.concat(F.lit("https://cdn"), (F.col("event_id") % 7).cast("string"), F.lit(".example.com/a.js")).alias("url"), F.when(F.col("event_type") == "view", 200 + 100 * (F.col("event_id") % 4).cast("int")).alias("status"),
                    F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("source"))


@register("g14_n02_failed_requests", f"SELECT page_id, url, status, count(*) AS occurrences FROM ({_LOG.format(t='VARCHAR')} events) WHERE kind = 'requestfailed' OR (kind = 'response' AND status >= 400) GROUP BY ALL")
def _(spark, d):
    return EV.failed_requests(_log(spark, d)).select("page_id", "url", "status", "occurrences")


@register("n04_error_rate", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS party, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    return EV.party_rate(events(spark, d).withColumn("party", F.col("event_type")), "1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("n09_capture_sessions", "SELECT user_id, min(ts) AS started, count(*) AS events FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) g FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) p FROM events)) GROUP BY user_id, g")
def _(spark, d):
    return EV.capture_sessions(events(spark, d), "user_id", "2 hours").select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "events")


@register("n11_milestones", "SELECT user_id, min(ts) FILTER (WHERE event_type = 'signup') AS signed_up, min(ts) FILTER (WHERE event_type = 'purchase') AS purchased FROM events GROUP BY 1")
def _(spark, d):
    m = EV.milestones(events(spark, d), "user_id", {"signed_up": "signup", "purchased": "purchase"})
    return m.select("user_id", F.col("signed_up").cast("timestamp_ntz").alias("signed_up"), F.col("purchased").cast("timestamp_ntz").alias("purchased"))


_ALLOW = {"view": ["click", "signup"], "click": ["purchase", "view"], "signup": ["view"], "purchase": ["view"], "error": []}
_OKS = lst([f"{a}>{b}" for a, bs in _ALLOW.items() for b in bs])


@register("h16_h17_run_states", f"SELECT event_id, p AS from_state, p IS NULL OR p = event_type OR (p || '>' || event_type) IN {_OKS} AS legal, CAST(floor(epoch_us(ts) / 1000.0) - floor(epoch_us(t0) / 1000.0) AS BIGINT) / 1000 AS elapsed_s FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) p, min(ts) OVER (PARTITION BY user_id) t0 FROM events)")
def _(spark, d):
    t = EV.run_transitions(events(spark, d), "user_id", "event_type", ["ts", "event_id"], F.date_trunc("day", "ts"), _ALLOW)
    return t.select("event_id", "from_state", "legal", (F.col("elapsed_ms") / 1000).alias("elapsed_s"))


@register("h18_new_phrases", "SELECT conv_id, turn FROM (SELECT *, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) b, nullif(regexp_extract(text, '(?i)\\b[a-z]{9,}\\b', 0), '') ph FROM conversations) WHERE ph IS NOT NULL AND NOT contains(lower(b), lower(ph))")
def _(spark, d):
    t = spark.read.parquet(f"{d}/conversations.parquet")
    return EV.new_phrases(t, "conv_id", ["turn"], r"(?i)\b[a-z]{9,}\b").select("conv_id", "turn")
