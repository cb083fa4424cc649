"""Resampling, mixing and conversation repair against plain Python on small tables."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelode.llm import importance, mixing, queries, repair
from pagelode.llm.running import running
from pagelode.llm.shared import Scratch

ODD = [None, "", "   ", "...", "Ein Haus", "naïve Façade – 東京 x1\x00y", "A a A a", "one " * 30, "long text, " * 4000]


def corpus(n=260, seed=3):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(40)] + ["Übung", "Zug", "a-b"]
    return ODD + [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(n)]


def documents(spark, texts, sources=("b", "a", None), ids=None):
    """Sources with a hot one; extra columns have names that the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, sources[0] if k % 3 else sources[k % len(sources)], "x", k, "c", 1.0) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string, rank int, part string, target double")


# ---- running totals


def test_running_totals_of_a_hot_group(spark):
    rows = [("k" if i % 4 else f"g{i % 12}", i * 7 % 101, i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    out, parts = running(df, Scratch(spark), [F.col("g"), F.col("o")], "v", by=("g",))
    for r in out.collect():
        low = sum(v for g, o, v in rows if g == r.g and o < r.o)
        assert low <= r.before <= low + sum(v for g, o, v in rows if g == r.g and o == r.o) - r.v
    assert parts.filter("g = 'k'").count() > 1
    assert running(df.limit(0), Scratch(spark), [F.col("o")], "v")[0].count() == 0


# ---- importance resampling


def plain_features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain_resample(rows, target, percent=25, least=20, buckets=10000):
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for texts, count in (([x for _, x in rows], s), (target, t)):
        for x in texts:
            for f in plain_features(x)[1]:
                count[at(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, x in rows:
        w, f = plain_features(x)
        weight = sum(gain[at(k)] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(w)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def drawn(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"] and set(dict(df.dtypes).values()) == {"bigint"}
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("few", [10_000, 3])
def test_resampling_equals_a_plain_version(spark, monkeypatch, few):
    monkeypatch.setattr(importance, "FEW", few)
    texts, ids = corpus(), [None, 1, *range(1, 268)]
    target = spark.createDataFrame([("w1 w2 w3 " * 9,), (None,)], "text string")
    got = drawn(importance.resample(documents(spark, texts, ids=ids).repartition(5), target, Scratch(spark)))
    assert got == plain_resample(list(zip(ids, texts)), ["w1 w2 w3 " * 9, None])


def test_resampling_of_odd_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(documents(spark, []), none, Scratch(spark)).count() == 0
    rows = [(7, "same words " * 20)] * 9  # ties in everything
    got = drawn(importance.resample(documents(spark, [t for _, t in rows], ids=[7] * 9), none, Scratch(spark)))
    assert got == plain_resample(rows, [])
    short = importance.resample(documents(spark, ["a b"]), none, Scratch(spark)).collect()
    assert short[0]["rank"] is None and short[0]["n_features"] == 3


def test_long_text_in_stretches(monkeypatch):
    from pagelode.llm import simhash

    text = ("Words and more, words " * 300).encode()
    whole = [x for _, x in importance.features(text, 97)]
    monkeypatch.setattr(simhash, "BLOCK", 64)
    parts = list(importance.features(text, 97))
    assert len(whole) == 1 and len(parts) > 50 and sum(n for n, _ in parts) == 1200
    assert sorted(sum((x.tolist() for _, x in parts), [])) == sorted(whole[0].tolist())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(-5, 5)), min_size=1, max_size=30))
def test_weighted_median_leaves_half_on_either_side(blocks):
    m = importance.weighted_median([(n, (k,)) for n, k in blocks])[0]
    total = sum(n for n, _ in blocks)
    assert sum(n for n, k in blocks if k <= m) * 2 >= total and sum(n for n, k in blocks if k >= m) * 2 >= total


def test_nth_key_equals_sorting(spark, monkeypatch):
    monkeypatch.setattr(importance, "FEW", 4)
    monkeypatch.setattr(importance, "BLOCK_KEYS", 32)
    r = random.Random(5)
    keys = [(r.randint(-3, 3), r.randint(0, 5), 0, i) for i in range(500)]
    df = spark.createDataFrame(keys, "k1 long, k2 long, k3 long, k4 long").repartition(6)
    for n in (1, 2, 250, 499, 500):
        assert importance.nth_key(df, n, Scratch(spark)) == sorted(keys)[n - 1]


# ---- mixing


def test_mixing_meets_targets_of_a_hot_source(spark):
    texts = corpus(900)
    df = documents(spark, texts, sources=("b", "a", None, "é"))
    out = mixing.mix(df, Scratch(spark)).collect()
    size = {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in enumerate(texts)}
    source = {r.doc_id: r.source for r in df.collect()}
    assert {r.doc_id: r["size"] for r in out} == size and len(out) == len(texts)
    total = {s: sum(size[i] for i in size if source[i] == s) for s in set(source.values())}
    names = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, budget = {}, 1.5 * sum(total.values())
    while True:  # share again without those at their cap
        left = [s for s in names if s not in target]
        level = (budget - sum(target.values())) / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * level > 2 * total[s]]
        if not over:
            break
        target |= {s: 2.0 * total[s] for s in over}
    target |= {s: weight[s] * level for s in left}
    for s in names:
        rows = [r for r in out if source[r.doc_id] == s]
        assert all(r.target == pytest.approx(target[s]) for r in rows) and {r.source_size for r in rows} == {total[s]}
        assert abs(sum(r.taken for r in rows) - target[s]) <= 1 + total[s] / 1000
    assert all(0 <= r.taken <= 2 * r["size"] for r in out) and sum(r.taken for r in out) == math.floor(budget)
    again = mixing.mix(df.repartition(7), Scratch(spark)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_mixing_of_odd_tables(spark):
    assert mixing.mix(documents(spark, []), Scratch(spark)).count() == 0
    out = mixing.mix(documents(spark, [None, "", " "]), Scratch(spark)).collect()
    assert [(r["size"], r.target, r.taken) for r in out] == [(0, 0.0, 0)] * 3
    same = mixing.mix(documents(spark, ["a b c", "a b c", "d"], sources=("s",), ids=[4, 4, None]), Scratch(spark)).collect()
    assert sum(r.taken for r in same) == 10 and {r.target for r in same} == {10.5}


def test_mixing_has_no_python_in_its_plan(spark):
    plan = mixing.mix(documents(spark, corpus(20)), Scratch(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExternalRDD", plan)


# ---- conversation repair


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{said(c)}:{said(t)}".encode()) % 20
        text, role = said(text), said(role)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(c, t, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1], r[2], r[3]))


def cheapest(rows):
    """Least (cost, audit, roles) over all edits, by trying every one; rows: (initial, must go, truncated)."""
    best = (10**9, "", "")

    def go(i, cost, audit, roles):
        nonlocal best
        if (cost, audit) > best[:2] and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, audit, roles))
        if not re.fullmatch("s?(ua)*u?", roles):
            return
        if not audit.endswith("II"):
            for r in "ua":
                go(i, cost + 3, audit + "I", roles + r)
        if i < len(rows):
            initial, gone, cut = rows[i]
            go(i + 1, cost + 4, audit + "D", roles)
            if not gone:
                go(i + 1, cost + 3 * cut, audit + "K", roles + initial)
                for r in "ua":
                    go(i + 1, cost + 3 + 3 * cut, audit + "R", roles + r)

    go(0, 0, "", "")
    return best


def plain_repair(rows):
    rows = plain_damage(rows)
    seen, marks, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in rows:
        visible = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None
        seen.add((role, text))
        marks.append((role[:1] if role[:1] in tuple("sua") else "o", fault in ("blank", "duplicate"), fault == "truncated"))
        if fault:
            count[fault] += 1
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, roles = cheapest(marks)
    lines, i, k = [], 0, 0
    for e in audit:
        role = "" if e == "D" else {"s": "system", "u": "user", "a": "assistant"}[roles[k]]
        if e == "I":
            lines.append(f"{role}:")
        elif e != "D":
            lines.append(f"{rows[i][2] if e == 'K' else role}:{rows[i][3]}")
        i, k = i + (e != "I"), k + (e != "D")
    return gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversations(seed=11, n=60):
    r = random.Random(seed)
    texts = ["Yes.", "Yes.", "no", "What? ", "", " \n", None, "Grüße…", "end!\x0b", "a.b"]
    rows = []
    for c in [None, *range(n)]:
        for t in range(r.randint(1, 5)):
            rows.append((c, r.choice([t, t, t, 2, None]), r.choice(["user", "assistant", "user", "assistant", "system", "s", "tool", "", None]), r.choice(texts)))
    return rows


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, audit string, at int")


def test_repair_equals_trying_all_edits(spark, tmp_path):
    rows = conversations()
    chats(spark, rows).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.QUERIES["op13_conversation_repair"](spark, str(tmp_path))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r.conv_id: tuple(r)[1:] for r in out.collect()}
    assert set(got) == {r[0] for r in rows}
    for c in got:
        assert got[c] == plain_repair([r for r in rows if r[0] == c]), c


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("suaoSUAOx", max_size=5), min_size=1, max_size=6))
def test_word_graph_equals_trying_all_edits(signatures):
    graph = repair.WordGraph()
    for s in signatures:
        rows = [(x.lower(), x == "x", x.isupper()) for x in s]
        assert graph.solve(s) == cheapest(rows)[:2]


def test_word_graph_keeps_shared_ends():
    graph, pushed = repair.WordGraph(), []
    push = graph.push
    graph.push = lambda s: (pushed.append(s), push(s))
    for s in sorted({"".join(p) + "uauaua" for p in itertools.product("sua", repeat=3)}, key=lambda x: x[::-1]):
        graph.solve(s)
    assert len(pushed) == 6 + 3 + 9 + 27


def test_long_conversation_is_spread_and_whole(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3000)] + [(2, 0, "user", "Hi.")]
    done = repair.Repair(chats(spark, rows).select(repair.conversation(), "turn", "role", "text"), Scratch(spark))
    assert done.rows.filter("conv = '=1'").select("part").distinct().count() > 1
    one = done.summary.filter("conv = '=1'").first()
    assert (one.cost, one.audit, one.illegal) == (0, "K" * 3000, 0)
    whole = "\n".join(f"{r}:{t}" for _, _, r, t in rows[:-1])
    assert {r.conv: r.repaired_sha256 for r in done.digests().collect()} == {"=1": hashlib.sha256(whole.encode()).hexdigest(), "=2": hashlib.sha256(b"user:Hi.\nassistant:").hexdigest()}
    turns = done.turns().filter("conv = '=2'").orderBy("seq").collect()
    assert [(r.seq, r.turn, r.role, r.text, r.edit) for r in turns] == [(0, 0, "user", "Hi.", "K"), (1, None, "assistant", "", "I")]


def test_repair_of_empty_tables_and_lost_conversations(spark):
    assert repair.repair(chats(spark, []), Scratch(spark)).count() == 0
    lost = next(c for c in range(500) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    out = repair.repair(chats(spark, [(lost, 0, "user", "Hello.")]), Scratch(spark)).collect()
    assert tuple(out[0]) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


# ---- line dedup on small hosts


def test_lines_of_hosts_of_one_and_two_pages_follow_the_ratio_alone(spark):
    from pagelode.llm import lines

    rows = [(1, "one", "alone"), (2, "two", "same\na"), (3, "two", "same\nb"), (4, None, "kept")] + [(10 + i, "many", f"line {i}\nshared {i // 2}") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, source string, text string")
    got = {r.page_id: r.text for r in lines.dedup(df, Scratch(spark)).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == ["", "", "", "kept"] and got[10] == "line 0\nshared 0"
    half = {r.page_id: r.text for r in lines.dedup(df, Scratch(spark), ratio=0.5).collect()}
    assert [half[i] for i in (1, 2, 3)] == ["", "a", "b"]
