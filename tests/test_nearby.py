"""Joins by place in a page against plain loops, and on pages large enough that pairs would not end."""

import random
import time

from pyspark.sql import functions as F

from pagelode.operators.nearby import nearest_form, section_bounds


def test_section_bounds_equal_a_search(spark):
    r = random.Random(3)
    rows = [(p, i, r.randint(1, 6), r.choice([None, *range(0, 90, 10)])) for p in range(12) for i in range(r.randint(0, 40))]
    want = {}
    for p, i, level, y in rows:
        if y is not None:
            after = [(o, oy) for q, o, ol, oy in rows if q == p and oy is not None and oy > y and ol <= level]
            want[p, i] = min(after)[1] if after else None
    got = section_bounds(spark.createDataFrame(rows, "page_id long, seq int, level int, y int")).collect()
    assert {(g.page_id, g.seq): g.bound for g in got} == want and len(got) == len(want)


def test_section_bounds_take_fractions_of_a_pixel(spark):
    rows = [(1, 0, 2, 1.0), (1, 1, 2, 1.25), (1, 2, 1, 1.5)]
    got = section_bounds(spark.createDataFrame(rows, "page_id long, seq int, level int, y double"))
    assert sorted((g.seq, g.bound) for g in got.collect()) == [(0, 1.25), (1, 1.5), (2, None)]


def search(control, forms):
    """Plain reading of the rule for one control; forms are (index, label, y)."""
    label, y, submits = control
    found = []
    for i, other, fy in forms:
        same = bool(label) and other == label
        if same or (submits and y is not None and fy is not None and y >= fy):
            gap = None if y is None or fy is None else abs(y - fy)
            found.append(((gap is None, gap or 0, i), (other or "") == (label or "")))
    if not found:
        return None
    (far, gap, i), same = min(found)
    return i if far or gap <= 1200 or same else None


def test_nearest_form_equals_a_search(spark):
    r = random.Random(8)
    some = lambda: (r.choice(["send", "go", "buy", "", None]), r.choice([None, *range(0, 4000, 200)]))
    forms = [(p, i, *some()) for p in range(60) for i in range(r.randint(0, 6))]
    controls = [(p, i, *some(), r.random() < 0.5) for p in range(60) for i in range(r.randint(0, 12))]
    want = {}
    for p, i, label, y, submits in controls:
        best = search((label, y, submits), [f[1:] for f in forms if f[0] == p])
        if best is not None:
            want[p, i] = best
    got = nearest_form(spark.createDataFrame(controls, "page_id long, index int, label string, y int, submits boolean"), spark.createDataFrame(forms, "page_id long, index int, label string, y int"), 1200).collect()
    assert {(g.page_id, g["index"]): g.form_index for g in got} == want and len(got) == len(want) > 100


def test_large_pages_are_not_paired(spark):
    n = 20000
    heads = spark.range(n).select(F.lit(1).alias("page_id"), F.col("id").cast("int").alias("seq"), (1 + F.col("id") % 6).cast("int").alias("level"), (F.col("id") * 10).cast("int").alias("y"))
    forms = spark.range(n).select(F.lit(1).alias("page_id"), F.col("id").cast("int").alias("index"), F.lit("send").alias("label"), (F.col("id") * 100).cast("int").alias("y"))
    controls = forms.select("page_id", "index", "label", (F.col("y") + 10).alias("y"), F.lit(True).alias("submits"))
    for made in (section_bounds(heads), nearest_form(controls, forms, 1200)):
        assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    began = time.time()
    assert section_bounds(heads).filter("bound IS NOT NULL").agg(F.sum(F.col("bound") - F.col("seq") * 10)).first()[0] > 0
    assert nearest_form(controls, forms, 1200).filter("index = form_index").count() == n
    assert time.time() - began < 60
