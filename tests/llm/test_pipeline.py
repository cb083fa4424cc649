"""The corpus pipeline, stage by stage, against plain Python on a small folder of tables."""

import collections
import random
import re
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from pagelode.llm import toxicity
from .test_text_operators import plain_best_fit, plain_repeats

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    """Clean, toxic, copied, nearly copied, repeating and odd documents of two sources and two languages."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abdegilmnorstuv") for _ in range(r.randint(3, 8)))
    words = [word() for _ in range(3000)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = prose(60)
    out = []
    for i in range(240):
        t = prose(r.randint(60, 150)) + "\n" + prose(20)
        if i % 6 == 0:
            at = t.split(" ")
            at.insert(r.randint(1, len(at) - 1), "vilegrub" + r.choice(["ber", "s", "ly", ""]))
            t = " ".join(at)
        if i % 3 == 1:
            t = "Read our other pages\n" + t
        if i % 40 == 2:
            t += "\n" + passage + " " + prose(5)
        out.append(t)
    out += [out[1], re.sub(r"\S+", "changed", out[4], count=2), None, "", "Read our other pages"]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 2}", len(t) if t else None) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int("vilegrub" in (t or ""))) for i, t in enumerate(texts()) if i < 240]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages_equal_plain_versions(spark, folder):
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "suffix-array dedup", "best-fit packing"]

    kept = stages["toxicity"](spark, docs, folder)
    assert kept.columns == docs.columns
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), P.F.crc32(P.F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    before, after = rows(docs), rows(kept)
    assert set(after) == {i for i, r in before.items() if model.score([r["text"]])[0] < 0.5}
    toxic = {i for i, r in before.items() if "vilegrub" in (r["text"] or "")}
    held = {i for i in before if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len((toxic & held) & set(after)) <= 1 and len(set(before) - toxic - set(after)) <= 2

    lined = rows(stages["line dedup"](spark, kept, folder))
    seen, pages = collections.Counter(), collections.Counter(r["source"] for r in after.values())
    for r in after.values():
        seen.update({(r["source"], x.strip(" ")) for x in (r["text"] or "").split("\n") if x.strip(" ")})
    bad = {k for k, n in seen.items() if n > 0.1 * pages[k[0]]}
    for i, r in after.items():
        want = None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip(" ")) not in bad)
        assert lined[i]["text"] == want and lined[i]["n_chars"] == (None if want is None else len(want))

    single = rows(stages["SimHash near-dedup"](spark, spark.createDataFrame(list(lined.values()), docs.schema), folder))
    sets = {i: shingles(r["text"]) for i, r in lined.items()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[b] = min(root[b], root[a])
    assert set(single) == {i for i in sets if root[i] == i}

    cut = rows(stages["suffix-array dedup"](spark, spark.createDataFrame(list(single.values()), docs.schema), folder))
    order = sorted(single)
    for i, (_, _, rest) in zip(order, plain_repeats([(single[i]["text"] or "").encode() for i in order], 200)):
        assert (cut[i]["text"] or "").encode() == rest
    assert any(len(cut[i]["text"] or "") < len(single[i]["text"] or "") for i in order)

    packed = stages["best-fit packing"](spark, spark.createDataFrame(list(cut.values()), docs.schema), folder).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {i: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for i, r in cut.items()}
    assert {i: sum(p["length"] for p in packed if p["doc_id"] == i) for i in lengths} == lengths
    assert len({p["sequence_id"] for p in packed}) == plain_best_fit([p["length"] for p in packed], 1024)


def test_run_gives_the_last_stage(spark, folder):
    out = P.run(spark, folder)
    assert {"doc_id", "piece", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
