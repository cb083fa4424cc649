"""Tokens, packing, fingerprints, lines and repeats against brute force on small tables."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pagelode.llm import bpe, lines, packing, queries, repeats, simhash, similar
from pagelode.llm.shared import Scratch

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SMALL = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Null and empty texts, exact and near copies, odd characters, one word, a long run of one letter.
TEXTS = [None, "", "   ", "one", "The quick brown fox, isn't it? 12345", "The quick brown fox, isn't it? 12345", "Grüße, naïve façade – 東京 🎉\n\tend", "a" * 5000, "word " * 3000, "x\x00y z", "<|endoftext|> plain"]


def docs(spark, texts, more=""):
    """doc_id and text, with extra columns whose names operators also use."""
    rows = [(i, t, i, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, key string")


def vocabulary_of(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_decodes(spark):
    out = bpe.encode(docs(spark, TEXTS).withColumn("ids", F.lit("clash")), VOCABULARY, PATTERN)
    got = {r.doc_id: r for r in bpe.decode(out, VOCABULARY, PATTERN).collect()}
    encode = vocabulary_of(VOCABULARY).encode_ordinary
    for i, t in enumerate(TEXTS):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == encode(t or "")
        assert bytes(got[i].decoded) == (t or "").encode()
        assert got[i].key == "k"


def test_bpe_long_text_in_runs(monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    monkeypatch.setattr(bpe, "RUN", 7)
    c, text = bpe.Codec(bpe.vocabulary(VOCABULARY, PATTERN)), "Many words make one long text. " * 20
    assert np.frombuffer(c.encode(text), "<u4").tolist() == vocabulary_of(VOCABULARY).encode_ordinary(text)
    assert c.decode(c.encode(text)) == text.encode()


def test_perfect_hash_is_minimal_and_perfect():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert [h.index(k) for k in keys] == list(range(5000)) and sorted(h.slots) == list(range(5000))


def test_empty_tables(spark):
    none = docs(spark, [])
    assert bpe.encode(none, VOCABULARY, PATTERN).count() == 0
    assert packing.pack(packing.pieces(none, SMALL, PATTERN, 2, 64), 64, Scratch(spark)).count() == 0
    assert simhash.near_duplicates(none, Scratch(spark)).count() == 0
    assert similar.keep_one(none, Scratch(spark)).count() == 0
    assert repeats.Repeats(none, Scratch(spark)).affected.count() == 0
    assert lines.dedup(none.withColumn("source", F.lit("a")), Scratch(spark)).count() == 0


def plain_best_fit(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        open_bins = [b for b in bins if b[0] >= n]
        if open_bins:
            b = min(open_bins)
            b[0] -= n
        else:
            bins.append([size - n])
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_on_counts_is_best_fit_item_by_item(seed):
    r = random.Random(seed)
    lengths = [r.choice([r.randint(1, 50), r.randint(1, 8), 13]) for _ in range(400)]
    plan = packing.best_fit(collections.Counter(lengths), 50)
    assert 1 + max(p[3] + (p[2] - 1) // p[4] for p in plan) == plain_best_fit(lengths, 50)
    assert sum(p[2] for p in plan) == 400


def test_packing_is_gapless_and_whole(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = packing.pack(packing.pieces(docs(spark, TEXTS + TEXTS[3:6]), SMALL, PATTERN, 2, 64), 64, Scratch(spark)).collect()
    for i, t in enumerate(TEXTS + TEXTS[3:6]):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
        assert len(ids) > 64 or len(own) == 1
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist() and sum(n for _, n in own) <= 64


def test_packing_recognises_added_tokens_in_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, added, end = Tokenizer.from_file(path), packing.added_tokens(path), "<|endoftext|>"
    assert added == {end: 50256}
    texts = [f"hello {end} world", end, f"{end}{end}", f"a{end}b", f"  {end}  \n{end}\n", f"it's{end}'s 12{end}34", "<|endoftext", f"<|endoftext{end}|>", None, "plain"]
    got = {r.doc_id: r for r in packing.pieces(docs(spark, texts), SMALL, PATTERN, 2, 1024, with_ids=True, added=added).collect()}
    for i, t in enumerate(texts):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want and got[i].length == len(want)
    assert np.frombuffer(got[0].ids, "<u4").tolist() == [31373, 220, 50256, 995, 2]


def test_queries_pack_with_added_tokens(spark, tmp_path):
    docs(spark, ["hello <|endoftext|> world"]).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(25)}).write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.length for r in queries.op2_best_fit_packing(spark, str(tmp_path)).collect()] == [5]
    assert [r.length for r in corpus_pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()] == [5]


def plain_fingerprint(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(monkeypatch):
    for t in [*TEXTS, "ÄÖ Ü A b C d", "one two"]:
        assert simhash.fingerprint(t) == plain_fingerprint(t, 3)
    long = " ".join(f"w{i * 7919 % 4001}" for i in range(3000))
    monkeypatch.setattr(simhash, "BLOCK", 500)
    assert simhash.fingerprint(long) == plain_fingerprint(long, 3)


def plain_components(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("crowd", [400, 3])
def test_pigeonhole_search_loses_no_link(spark, monkeypatch, crowd):
    """Random fingerprints, neighbours at one to three bits, and a crowd around one; both routes."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    r, fps = random.Random(crowd), []
    for _ in range(60):
        base = r.getrandbits(64)
        fps += [base] + [base ^ sum(1 << b for b in r.sample(range(64), k)) for k in (1, 2, 3)]
    fps += [fps[0] ^ (1 << b) for b in range(40)] + [fps[0] ^ (1 << b) ^ (1 << (b + 1)) for b in range(40)]
    signed = sorted({f - 2**64 if f >= 2**63 else f for f in fps})
    edges = simhash.near_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), 2, Scratch(spark))
    found = edges.collect()
    number = {f: i for i, f in enumerate(signed)}
    assert all(bin((e.a ^ e.b) & (2**64 - 1)).count("1") <= 2 for e in found)
    root = list(range(len(signed)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for e in found:
        a, b = find(number[e.a]), find(number[e.b])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(signed))] == plain_components(signed, 2)


def test_near_duplicates_of_texts(spark):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, TEXTS), Scratch(spark)).collect()}
    fps = [plain_fingerprint(t, 3) for t in TEXTS]
    assert [got[i].fp % 2**64 for i in range(len(TEXTS))] == fps
    assert [got[i].component_id for i in range(len(TEXTS))] == plain_components(fps, 2)


def test_similar_keeps_one_of_near_copies_and_all_others(spark):
    r = random.Random(4)
    texts = [" ".join(f"w{r.randint(0, 9999)}" for _ in range(200)) for _ in range(30)]
    near = [re.sub(r"\S+", "changed", t, count=2) for t in texts[:10]]
    ids = sorted(x.doc_id for x in similar.keep_one(docs(spark, texts + near + texts[:3]), Scratch(spark)).collect())
    assert ids == list(range(30))


def test_similar_rows_with_equal_or_missing_ids(spark):
    rows = [(1, "same text here for all of us"), (1, "same text here for all of us"), (None, "no id"), (2, None), (3, "")]
    out = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()
    assert sorted((x.doc_id or 0) for x in out) == [0, 1, 2]


def plain_similar(texts, least=0.8):
    """Smallest number reachable over pairs of five-word shingle sets of that similarity, by brute force."""
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split() for t in texts]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("block_bytes", [similar.BLOCK_BYTES, 3000])
def test_similar_links_by_the_sets_alone(spark, monkeypatch, block_bytes):
    """Pairs just under and at or over the wanted similarity, which fingerprints do not tell apart, and a chain."""
    monkeypatch.setattr(similar, "BLOCK_BYTES", block_bytes)
    r, texts = random.Random(11), []
    word = lambda: f"w{r.randint(0, 99999)}"
    for changed in [40] * 25 + [47] * 25 + [36] * 25:  # the tail of 360 shingles: similarities 0.8, 0.77, 0.82
        w = [word() for _ in range(364)]
        texts += [" ".join(w), " ".join(w[:-changed] + [word() for _ in range(changed)])]
    w = [word() for _ in range(300)]
    texts += [" ".join(w[k : k + 250]) for k in range(0, 50, 10)]
    got = {x.doc_id: x.component_id for x in similar.groups(docs(spark, texts), Scratch(spark)).collect()}
    want = plain_similar(texts)
    assert want[50:100] == list(range(50, 100)) and all(got[i] in (i, want[i]) for i in got)  # no link that the sets do not make
    assert sum(got[i] != want[i] for i in got) <= 4  # pairs that met in no partition


def test_similar_links_by_pigeonhole_search_first(spark, monkeypatch):
    """Near copies are linked without the wide fingerprints, and no text they connect is compared again."""
    compared = []

    def no_cells(rows, parts, work, schema, weight=None):
        compared.append(rows)
        return rows.sparkSession.createDataFrame([], schema)

    monkeypatch.setattr(similar, "in_cells", no_cells)
    r = random.Random(8)
    long = [[f"w{r.randint(0, 10**6)}" for _ in range(3000)] for _ in range(4)]
    texts = [" ".join([*w[:-1], f"end{k}"] if k else w) for w in long for k in range(5)]
    got = {x.doc_id: x.component_id for x in similar.groups(docs(spark, texts), Scratch(spark)).collect()}
    assert got == {i: i - i % 5 for i in range(20)}
    assert compared[0].select("node", "root").distinct().groupBy("root").count().filter("count = 5").count() == 4


def test_similar_counts_a_repeated_shingle_once(spark):
    """A row of fillers makes up most shingles of each text, but their sets are apart."""
    r = random.Random(5)
    prose = [" ".join(f"w{r.randint(0, 99999)}" for _ in range(60)) for _ in range(40)]
    texts = [p + " -" * r.randint(200, 400) for p in prose] + [p + " -" * r.randint(900, 999) for p in prose[:20]]
    got = {x.doc_id: x.component_id for x in similar.groups(docs(spark, texts), Scratch(spark)).collect()}
    assert [got[i] for i in range(60)] == plain_similar(texts) == [*range(40), *range(20)]


def plain_repeats(texts, length):
    """(removed, spans, kept) of each text, by counting every window."""
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        spans = repeats.union([(i, i + length) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1])
        gone = set(x for a, b in spans for x in range(a, b))
        out.append((len(gone), len(spans), bytes(c for i, c in enumerate(t) if i not in gone)))
    return out


def repeat_texts(seed):
    r = random.Random(seed)
    make = lambda n: "".join(r.choice("ab cdé") for _ in range(n))
    shared = [make(r.randint(30, 120)) for _ in range(4)]
    texts = [make(r.randint(0, 150)) for _ in range(15)]
    for _ in range(40):
        s = r.choice(shared)
        a, b = sorted((r.randint(0, len(s)), r.randint(0, len(s))))
        texts.append(make(r.randint(0, 60)) + s[a:b] + make(r.randint(0, 60)) + (s if r.random() < 0.3 else ""))
    return texts + texts[:3] + [None, "", "z" * 300, "yx" * 150, shared[0] * 3]


@pytest.mark.parametrize("seed,hot", [(1, 10**6), (2, 10**6), (3, 2)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(repeats, "RUN", 50)
    texts = repeat_texts(seed)
    df = docs(spark, texts)
    affected = {bytes(r.key): r for r in repeats.Repeats(df, Scratch(spark), 32, hot=hot).affected.collect()}
    for t, (removed, spans, kept) in zip(texts, plain_repeats([(t or "").encode() for t in texts], 32)):
        data = (t or "").encode()
        r = affected.get(hashlib.sha256(data).digest())
        assert ((r.n_removed, r.n_spans, bytes(r.kept)) if r else (0, 0, data)) == (removed, spans, kept)


def test_anchors_of_a_long_text_are_those_of_its_windows():
    r = np.random.default_rng(2)
    long = r.integers(97, 123, (1 << 20) + 5000, np.uint8).tobytes()
    got = repeats.anchors([b"short", long, long[:400]], 200, 50)
    number, position, least, most, _ = (x.tolist() for x in got)
    assert sum(b - a + 1 for n, a, b in zip(number, least, most) if n == 1) == len(long) - 199
    assert len(set(zip(number, position))) == len(number)
    # windows of the copy have the anchors that equal windows of the long text have
    own = {p: (a, b) for n, p, a, b in zip(number, position, least, most) if n == 1}
    assert all(p in own for n, p in zip(number, position) if n == 2)


def test_merge_orders_runs_and_tells_common_prefixes():
    r = random.Random(8)
    runs = [sorted((("".join(r.choice("ab") for _ in range(r.randint(0, 9)))).encode(), bytes([r.randint(0, 3)]), i) for _ in range(r.randint(0, 30))) for i in range(7)]
    got = list(repeats.merge([repeats.read_run(repeats.front_code(x)) for x in runs]))
    flat = sorted((e[0], e[1]) for run in runs for e in run)
    assert [(g[1], g[2]) for g in got] == flat
    assert all(g[0] == repeats.common(a, g[1]) for a, g in zip([b""] + [g[1] for g in got], got))


def test_line_dedup_by_host(spark):
    rows = [(i, f"Menu\nbody {i}\nMenu\n\n  ", "a", 7) for i in range(8)] + [(20 + i, f"Menu\nbody {i}", "b" if i else None, 7) for i in range(2)] + [(30, None, "a", 7), (31, "", "a", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int")
    got = {r.doc_id: r for r in lines.dedup(df, Scratch(spark), 0.5, 3).collect()}
    assert got[3].text == "body 3\n\n  " and (got[3].n_lines, got[3].n_dropped) == (5, 2)
    assert got[20].text == "Menu\nbody 0" and got[21].text == "Menu\nbody 1"
    assert got[30].text is None and got[31].text == "" and len(got) == 12


def test_line_dedup_without_broadcast_is_the_same(spark, monkeypatch):
    rows = [(i, f"Menu\nbody {i % 3}\nown {i}", f"h{i % 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(lines.dedup(df, Scratch(spark)).collect())
    monkeypatch.setattr(lines, "BROADCAST_LINES", -1)
    assert sorted(lines.dedup(df, Scratch(spark)).collect()) == want


def test_page_lines(spark):
    row = spark.createDataFrame([("<html><script>x<1</script><p>A <b>b</b></p><!-- c --><div>  D</div>", "HTTPS://u@Ex.Org:80/p")], "h string, u string").select(lines.page_lines(F.col("h")), lines.host_of(F.col("u"))).first()
    assert tuple(row) == ("A b\nD", "ex.org")
