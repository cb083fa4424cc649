"""Search, near-duplicate vectors, transcripts and classifiers on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelode.llm import components, langid, mih, rabitq, toxicity, transcripts
from pagelode.llm.shared import Scratch

NAN, INF = float("nan"), float("inf")
#: Vectors that take no part, and one of another length.
ODD = [None, [0.0] * 8, [1.0, NAN] + [0.0] * 6, [INF] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0]]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, ids string")


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components.connected(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    want = {x: find(x) for a, b in edges for x in (a, b) if a != b}
    assert got == want


def test_search_finds_neighbours_with_ties_and_copies(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 8)).astype(np.float32)
    x[50:90] = x[0]  # forty copies of a query
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000 + i, v, 0) for i, v in enumerate(ODD)]
    df = vectors(spark, rows)
    got = mih.search(df, df.filter("vec_id % 20 = 0"), Scratch(spark), 5).collect()
    hits = total = 0
    for q in range(0, 400, 20):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(400), d))[:5]
        own = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
        assert [o[0] for o in own] == [1, 2, 3, 4, 5] and all(o[2] == d[o[1]] for o in own)
        hits += len({o[1] for o in own} & set(best.tolist()))
        total += 5
    assert hits / total >= 0.9
    assert sorted(g.vec_id for g in got if g.query_id == 0) == [50, 51, 52, 53, 54]
    assert not any(g.query_id >= 1000 or g.vec_id >= 1000 for g in got)


def test_search_in_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.0], 0)]
    df = vectors(spark, rows)
    got = mih.search(df, df.filter("vec_id = 0"), Scratch(spark), 10).collect()
    assert [(g.rank, g.vec_id) for g in sorted(got, key=lambda g: g.rank)] == [(1, 2), (2, 1)]
    assert mih.search(vectors(spark, []), vectors(spark, []), Scratch(spark)).count() == 0


def test_pigeonhole_retrieves_every_code_within_the_radius():
    r = np.random.default_rng(5)
    codes = r.integers(0, 2**63, 3000, np.uint64)
    codes[:500] = codes[0] ^ (np.uint64(1) << r.integers(0, 63, 500).astype(np.uint64))
    index = mih.Index(codes)
    for radius in (0, 1, 3, 9, 22):
        got = index.within(int(codes[0]), radius)
        assert got.tolist() == np.flatnonzero(np.bitwise_count(codes ^ codes[0]) <= radius).tolist()


@pytest.mark.parametrize("block", [2048, 7])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(rabitq, "BLOCK", block)
    r = np.random.default_rng(6)
    base = r.normal(size=(30, 16))
    rows, at = [], 0
    for i, b in enumerate(base):
        for _ in range(1 + i % 9):
            v = b + r.normal(size=16) * 0.12 * np.linalg.norm(b) / 4
            rows.append((at, v.astype(np.float32).tolist(), None if i == 5 else i % 3))
            at += 1
    rows += [(at + i, rows[7][1], rows[7][2]) for i in range(4)]
    rows += [(1000 + i, v, 0) for i, v in enumerate(ODD)]
    got = {g.vec_id: g for g in rabitq.near_duplicates(vectors(spark, rows), Scratch(spark)).collect()}
    valid = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if i < 1000 and lab is not None]
    links = {i: [j for j, w, m in valid if j != i and m == lab and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93] for i, v, lab in valid}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links.get(i, [])), min(seen), min(seen) == i)


def test_near_vectors_of_an_empty_table(spark):
    assert rabitq.near_duplicates(vectors(spark, []), Scratch(spark)).count() == 0
    assert rabitq.near_duplicates(vectors(spark, [(1, None, 1), (2, [0.0], None)]), Scratch(spark)).filter("n_links = 0 AND kept").count() == 2


def lengths_table(spark, seed):
    """Vectors of three lengths, some near each other, under columns whose names the operators use themselves."""
    r = np.random.default_rng(seed)
    rows = []
    for dim, n in ((16, 120), (5, 60), (3, 1)):
        base = r.normal(size=(n // 3 + 1, dim))
        for i in range(n):
            v = (base[i % len(base)] + 0.05 * r.normal(size=dim)).astype(np.float32)
            rows.append((len(rows), v.tolist(), i % 2, 7, -1, "q", 0))
    rows += [(None, rows[3][1], 1, 7, -1, "q", 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, dim int, node int, key string, shard int")


def test_search_takes_vectors_of_every_length(spark):
    rows, df = lengths_table(spark, 11)
    got = mih.search(df, df.filter("vec_id % 10 = 0"), Scratch(spark), 4).collect()
    x = {i: np.array(v, float) for i, v, *_ in rows if i is not None}
    hits = total = 0
    for q in range(0, 181, 10):
        near = sorted((float(np.sqrt(((x[i] - x[q]) ** 2).sum())), i) for i in x if i != q and len(x[i]) == len(x[q]))[:4]
        own = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
        assert len(own) == len(near) and all(len(x[i]) == len(x[q]) for _, i, _ in own)
        assert all(abs(s - np.sqrt(((x[i] - x[q]) ** 2).sum())) < 1e-12 for _, i, s in own)
        hits += len({i for _, i, _ in own} & {i for _, i in near})
        total += len(near)
    assert hits / total >= 0.9


def test_near_vectors_of_every_length_link_with_their_own(spark):
    rows, df = lengths_table(spark, 12)
    got = {g.vec_id: g for g in rabitq.near_duplicates(df, Scratch(spark)).collect()}
    x = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab, *_ in rows]
    links = [[b for b, (_, w, m) in enumerate(x) if b != a and m == lab and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93] for a, (_, v, lab) in enumerate(x)]
    assert any(links[a] for a in range(120)) and any(links[a] for a in range(120, 180))
    for a, (i, _, _) in enumerate(x):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        smallest = min(x[b][0] for b in seen if x[b][0] is not None)
        assert (got[i].n_links, got[i].component_id) == (len(links[a]), smallest)


def test_estimates_are_unbiased_and_within_the_bounds():
    r = np.random.default_rng(7)
    x, y = r.normal(size=(300, 64)), r.normal(size=(300, 64))
    x, y = x / np.linalg.norm(x, axis=1)[:, None], y / np.linalg.norm(y, axis=1)[:, None]
    y = 0.9 * x + 0.4 * y
    c = rabitq.Coder(64, 8, 1)
    factors = c.factors(x)
    error = (c.estimator(c.signs(x), factors) * y).sum(1) - (x * y).sum(1)
    assert abs(error.mean()) < 0.01 and (np.abs(error) < c.margin(factors)).all()


def test_viterbi_in_chunks_equals_viterbi_in_one_piece():
    r = np.random.default_rng(9)
    n = transcripts.STATES
    model = transcripts.estimate({("step", a, b): float(r.integers(0, 9)) for a in range(n) for b in range(n)})
    scores = r.normal(size=(97, n))
    whole = transcripts.viterbi(model.step, scores, model.start)
    cuts = [0, 1, 30, 60, 97]
    parts = [scores[a:b] for a, b in zip(cuts, cuts[1:])]
    states = transcripts.crossings(model, [transcripts.passage(model.step, p) for p in parts])
    out = []
    for p, (first, last) in zip(parts, states):
        entry = np.full(n, -np.inf)
        entry[first] = 0
        out += transcripts.viterbi(model.step, p, entry, last).tolist()
    assert out == whole.tolist()


@pytest.mark.parametrize("chunk", [2048, 5])
def test_transcripts_get_their_roles_back(spark, monkeypatch, chunk):
    monkeypatch.setattr(transcripts, "CHUNK", chunk)
    rows = []
    for c in range(40):
        for t in range(9):
            role = "user" if t % 2 == 0 else "assistant"
            body = "Short one?" if role == "user" else "A long answer " * 14 + "\nmore of it"
            rows.append((c, t, role, "\n" + (body if (c + t) % 4 == 0 else f"{'Q' if role == 'user' else 'A'}: {body}")))
    rows += [(99, 0, "user", None), (99, 1, "user", ""), (None, 1, "user", "lost"), (98, 0, "user", "Human: hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    scratch = Scratch(spark)
    seen = scratch.cut(transcripts.symbols(transcripts.lines_of(df, carry=("role",))))
    state = F.expr("2 * (array_position(array('system', 'user', 'assistant'), role) - 1) + IF(opens, 0, 1)").cast("int")
    model = transcripts.estimate(transcripts.counted(seen.withColumn("state", state)))
    got = sorted(transcripts.parse(seen, model, scratch).filter("conv < 40").collect(), key=lambda g: (g.conv, g.turn))
    assert [(g.conv, g.role) for g in got] == [(c, "user" if t % 2 == 0 else "assistant") for c in range(40) for t in range(9)]
    assert got[1].rendered == "<|assistant|>\n" + "A long answer " * 14 + "\nmore of it\n<|end|>"
    assert transcripts.parse(seen.filter("conv = 7"), model, Scratch(spark)).count() == 9
    assert transcripts.lines_of(df.filter("1 = 0")).count() == 0


def test_turns_keep_blank_lines(spark):
    bodies = ["one\n\n\ntwo\n \t\n    code\n\nend", "just this", "ends in blanks  \n\n \n", "x\r\n\r\ny", "  \n ", "é\n\n漢字\n"]
    names = ["Human", "AI"]
    rows = [(c, t, names[t % 2], "\n" * ((c + t) % 3) + f"{names[t % 2]}: {bodies[(c + t) % len(bodies)]}") for c in range(12) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, name string, text string")
    scratch = Scratch(spark)
    seen = scratch.cut(transcripts.symbols(transcripts.lines_of(df, carry=("name",))))
    state = F.expr("2 * array_position(array('Human', 'AI'), name) + IF(opens, 0, 1)").cast("int")
    got = transcripts.parse(seen, transcripts.estimate(transcripts.counted(seen.withColumn("state", state))), scratch).collect()
    want = {(c, t): bodies[(c + t) % len(bodies)] for c in range(12) for t in range(6)}
    # A marker with nothing visible after it takes no white space along.
    assert {(g.conv, g.turn): g.content for g in got} == {k: v if v.strip() else " " + v for k, v in want.items()}
    assert {g.role for g in got if g.turn % 2} == {"assistant"} and len(got) == len(rows)


def test_many_blank_lines_take_one_pass(spark):
    text = "a" + "\n" * 200000 + "b\n" * 100000 + " \n" * 200000
    df = spark.createDataFrame([(1, 0, text)], "conv_id long, turn long, text string")
    got = transcripts.lines_of(df).agg(F.count("*").alias("n"), F.sum(F.length("lead") + F.length("line") + F.length("tail")).alias("m"), F.count_if("blank_before").alias("gaps")).first()
    assert (got.n, got.m, got.gaps) == (100001, len(text) + 1, 1)


SAMPLES = {"en": "the cat and the dog went with that other one over there", "de": "der hund und die katze gingen mit dem anderen über straße", "fr": "le chat et le chien sont allés avec les autres près d'ici", "es": "el gato y el perro fueron con los otros por la calle allí"}


def language_rows(n):
    r = random.Random(2)
    out = []
    for i in range(n):
        lang = list(SAMPLES)[i % 4]
        words = SAMPLES[lang].split()
        out.append((i, " ".join(r.choice(words) for _ in range(12)), lang, "x"))
    return out


def test_language_identification(spark):
    df = spark.createDataFrame(language_rows(400) + [(900, None, "en", "x"), (901, "12 !?", "en", "x"), (902, "", None, "x")], "doc_id long, text string, lang string, lang_pred string")
    model = langid.fit(df, F.floor(F.col("doc_id") / 4) % 2 == 0)
    got = {g.doc_id: g for g in langid.identify(df, model).collect()}
    right = [got[i].lang_pred == lang for i, _, lang, _ in language_rows(400) if i // 4 % 2]
    assert sum(right) / len(right) >= 0.98
    assert all(got[i].lang_pred == "und" and got[i].lang_score == 0 and got[i].lang_ambiguous for i in (900, 901, 902))
    nobody = langid.fit(df.filter("1 = 0"), F.lit(True))
    assert langid.identify(df, nobody).filter("lang_pred = 'und'").count() == 403


def test_codewords_are_apart():
    for n in (2, 4, 9, 30):
        c = langid.codewords(n)
        apart = (c[:, None] != c[None]).sum(-1) + c.shape[1] * np.eye(n, dtype=int)
        assert apart.min() >= max(1, c.shape[1] // 4)


def test_toxicity_learns_words_and_their_relatives(spark):
    r = random.Random(3)
    rows = []
    for i, text, lang, _ in language_rows(900):
        toxic = int(i % 7 == 0)
        words = text.split()
        if toxic:
            words.insert(r.randint(0, len(words)), "grumblo" + r.choice(["t", "tten", "sk", "xi", "m"]))
        rows.append((i, " ".join(words), lang, toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, y int")
    labels = df.select("doc_id", F.col("y").alias("toxic"))
    model = toxicity.fit(df, labels, F.col("doc_id") % 5 != 0)
    odd = spark.createDataFrame([(-1, None, "en", 0), (-2, "", "en", 0)], df.schema)
    got = {g.doc_id: g for g in toxicity.score(df.union(odd), model).collect()}
    held = [(got[i].toxic_pred, y) for i, _, _, y in rows if i % 5 == 0]
    assert sum(p == y for p, y in held) / len(held) >= 0.97
    assert got[-1].toxic_score == got[-2].toxic_score and got[-1].toxic_pred == 0
    nothing = toxicity.fit(df, labels.filter("1 = 0"), F.lit(True))
    assert toxicity.score(df, nothing).filter("toxic_score = 0").count() == 900


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """Each word is in three of 12,000 rows, so a model of half of them misses most."""
    monkeypatch.setattr(toxicity, "EPOCHS", (1, 1), raising=False)
    word = F.substring(F.sha2(F.concat(F.floor(F.col("doc_id") / 6), F.col("doc_id") % 2).cast("string"), 256), 1, 9)
    df = spark.range(12_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic")).withColumn("text", word).withColumn("lang", F.lit("en"))
    model = toxicity.fit(df, df.select("doc_id", "toxic"), F.lit(True))
    got = toxicity.score(df, model).agg(F.avg((F.col("toxic_pred") == F.col("toxic")).cast("int"))).first()[0]
    assert got >= 0.9


def test_thresholds_equal_all_cuts_tried(spark):
    r = random.Random(8)
    rows = [(lang, (y := int(r.random() < 0.3)), round(r.gauss(2 * y, 1), 1)) for lang in ("", "de", "en") for _ in range(400)]
    got = toxicity.thresholds(spark.createDataFrame(rows, "lang string, y int, z double").repartition(5), Scratch(spark))
    for lang in ("", "de", "en"):
        z, y = np.array([x[2] for x in rows if x[0] == lang]), np.array([x[1] for x in rows if x[0] == lang])
        f1 = lambda cut: 2 * y[z >= cut].sum() / ((z >= cut).sum() + y.sum())
        assert abs(f1(got[lang]) - max(map(f1, z))) < 1e-12


def test_long_text_is_pooled_in_runs(monkeypatch):
    net = toxicity.Network()
    rows = toxicity.rows_of("some words in a text that is longer than one run of words " * 9)
    whole = net.pooled(rows)
    monkeypatch.setattr(toxicity, "RUN", 10)
    parts = net.pooled(rows)
    assert np.allclose(whole[0], parts[0]) and (whole[1] == parts[1]).all()
