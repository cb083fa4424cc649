"""Table functions of SQL against their DataFrame twins."""

from pyspark.sql import functions as F

from pagelode.functions.tables import register_tables
from pagelode.functions.text import sentences
from pagelode.operators import markup as M
from pagelode.operators.structured import json_nodes

DOCS = [
    '{"@type":"A","x":[1,{"@type":["B","C"]},[{"y":2}]],"z":{"@type":null,"t":"é"}}', "[]", "[{\"@type\":\"D\"},3]", '{"@type":7}', "not json", None, '"text"']


def test_table_functions_equal_their_twins(spark):
    assert register_tables(spark) == ["pl_tokens", "pl_sentences", "pl_json_ld_nodes"]
    pages = spark.createDataFrame([(1, "u", "<p class='a'>Hi <b>you</b><script>x = '</p>'</script><!-- c --><br/> end"), (2, "u", ""), (3, "u", None)], "page_id long, url string, html string")
    got = spark.sql("SELECT p.page_id, t.* FROM {p} AS p, LATERAL pl_tokens(p.html) AS t", p=pages)
    want = M.tokens(pages).select("page_id", "seq", "tok", "kind", "tag")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.count() > 8

    texts = spark.createDataFrame([(1, "One. Two? three! Four | five • six.  "), (2, ""), (3, None), (4, "a b. C")], "id long, text string")
    got = spark.sql("SELECT d.id, s.* FROM {d} AS d, LATERAL pl_sentences(d.text) AS s", d=texts)
    want = texts.select("id", F.posexplode(sentences("text")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.filter("id = 1").count() == 5

    docs = spark.createDataFrame([(i, 0, d) for i, d in enumerate(DOCS)], "page_id int, seq int, json string")
    got = spark.sql("SELECT j.page_id, n.path, n.types, n.node FROM {j} AS j, LATERAL pl_json_ld_nodes(j.json) AS n", j=docs)
    want = json_nodes(docs.filter("try_parse_json(json) IS NOT NULL"), "json").select("page_id", "path", "types", F.to_json(F.parse_json("node")).alias("node"))
    key = lambda r: (r.page_id, r.path)
    assert [tuple(r) for r in sorted(got.collect(), key=key)] == [tuple(r) for r in sorted(want.collect(), key=key)] and got.count() == 6
