"""Nested JSON: structured-data nodes and third-party form schemas, walked inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelode.functions.base import blank_to_null, chain, let, txt
from pagelode.functions.labels import field_purpose, is_junk_field
from pagelode.functions.text import strip
from pagelode.operators.markup import first_wins


def _children(node: Column) -> Column:
    """Nested objects and arrays of a JSON text, as JSON texts in source order."""
    text = lambda vs: F.transform(vs, lambda v: F.to_json(v))
    inner = F.when(node.startswith("{"), text(F.map_values(F.from_json(node, "map<string,variant>")))).when(
        node.startswith("["), text(F.from_json(node, "array<variant>"))
    )
    return F.coalesce(inner, F.array().cast("array<string>"))


def nesting(doc: Column) -> Column:
    """How deep a JSON text is nested, by its brackets outside strings."""
    bare = F.regexp_replace(doc, r'"(?:[^"\\]|\\.)*+"', "")
    step = "struct<d:int,m:int>"

    def count(a: Column, b: Column) -> Column:
        d = a["d"] + F.when(b.isin("{", "["), 1).otherwise(-1)
        return F.struct(d.alias("d"), F.greatest(a["m"], d).alias("m")).cast(step)

    seed = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")).cast(step)
    return F.aggregate(F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), F.lit(0)), seed, count, lambda a: a["m"])


def json_tree(doc: Column) -> Column:
    """array<struct<path, node>> of every object and array in a document, however deep."""
    step = "struct<path:string,node:string>"
    start = F.array(F.struct(F.lit("0").alias("path"), strip(doc).alias("node")).cast(step))

    def expand(front: Column) -> Column:
        # The index is padded so that sorting by path is document order.
        kids = lambda x: F.transform(
            _children(x["node"]),
            lambda v, i: F.struct(F.concat(x["path"], F.lit("."), F.lpad(i.cast("string"), 6, "0")).alias("path"), v.alias("node")),
        )
        return F.filter(F.flatten(F.transform(front, kids)), lambda x: x["node"].startswith("{") | x["node"].startswith("["))

    def level(acc: Column, _: Column) -> Column:
        return let(expand(acc["front"]), lambda nxt: F.struct(F.concat(acc["all"], nxt).alias("all"), nxt.alias("front")))

    seed = F.struct(start.alias("all"), start.alias("front"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.coalesce(nesting(doc), F.lit(1)))), seed, level, lambda acc: acc["all"])


def json_nodes(df: DataFrame, col: str) -> DataFrame:
    """(page_id, seq, path, node, types): one row per JSON object, in document order by path."""
    flat = df.select("page_id", "seq", F.explode(json_tree(F.col(col))).alias("x")).select("page_id", "seq", "x.*")
    kind = F.get_json_object("node", "$.@type")
    types = F.when(kind.startswith("["), F.from_json(kind, "array<string>")).when(kind.isNotNull(), F.array(kind)).otherwise(
        F.array().cast("array<string>")
    )
    return flat.filter(F.col("node").startswith("{")).withColumn("types", types)


def structured_types(nodes: DataFrame) -> DataFrame:
    """Distinct @type values of a page, first seen first."""
    t = nodes.select("page_id", "seq", "path", F.posexplode("types").alias("i", "type")).withColumn("type", strip(F.col("type")))
    return first_wins(t.filter("type <> ''"), ["page_id", "type"], ["seq", "path", "i"])


def organization_names(nodes: DataFrame) -> DataFrame:
    """Names of organisation-like nodes, each once."""
    is_org = F.exists("types", lambda t: t.rlike("(?i)Organization|LocalBusiness|Corporation|WebSite|Brand"))
    name = strip(F.coalesce(F.get_json_object("node", "$.name"), F.get_json_object("node", "$.legalName")))
    t = nodes.filter(is_org).withColumn("name", name).filter("name <> ''")
    t = first_wins(t, ["page_id", "name"], ["seq", "path"])
    w = W.partitionBy("page_id").orderBy("seq", "path")
    return t.withColumn("i", F.row_number().over(w)).select("page_id", "i", "name")


def postal_addresses(nodes: DataFrame) -> DataFrame:
    parts = [blank_to_null(F.get_json_object("node", f"$.{k}")) for k in (
        "streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")]
    t = nodes.filter(F.array_contains("types", "PostalAddress")).withColumn("address", F.concat_ws(", ", *parts)).filter("address <> ''")
    return first_wins(t, ["page_id", "address"], ["seq", "path"]).select("page_id", "seq", "path", "address")


def review_bodies(nodes: DataFrame) -> DataFrame:
    """Normalised review texts: reviewBody of any node, description of a review node."""
    norm = lambda s: F.lower(F.trim(F.regexp_replace(F.regexp_replace(s, "[“”‘’\"']", ""), r"\s+", " ")))
    is_review = F.exists("types", lambda t: t.rlike("(?i)review|testimonial"))
    body, desc = F.get_json_object("node", "$.reviewBody"), F.get_json_object("node", "$.description")
    both = F.array_compact(F.array(
        F.when(F.length(strip(body)) > 20, norm(body)), F.when(is_review & (F.length(strip(desc)) > 20), norm(desc))
    ))
    return nodes.select("page_id", F.explode(both).alias("body"))


# Question types of third-party form schemas.
SCHEMA_TYPES = [
    "short_text", "long_text", "email", "phone_number", "number", "multiple_choice", "yes_no", "dropdown", "legal",
    "website", "file_upload", "date", "opinion_scale", "rating", "nps", "matrix", "ranking", "picture_choice",
    "contact_info", "calendly", "address", "payment", "statement",
]
SCHEMA_TYPE_NAMES = {
    "short_text": "text", "long_text": "textarea", "phone_number": "tel", "multiple_choice": "radio",
    "picture_choice": "radio", "dropdown": "select", "yes_no": "radio", "calendly": "calendar",
}


def schema_fields(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """Questions of embedded-form payloads(page_id, seq, payload): type, label, required, choices."""
    flat = payloads.select("page_id", "seq", F.explode(json_tree(F.col(col))).alias("x")).select("page_id", "seq", "x.*")
    g = lambda p: F.get_json_object("node", p)
    title = F.coalesce(blank_to_null(g("$.title")), g("$.question"))
    t = flat.filter(F.col("node").startswith("{")).withColumn("raw_type", g("$.type")).withColumn("label", title)
    t = t.filter(F.col("raw_type").isin(SCHEMA_TYPES) & (txt(F.col("label")) != ""))
    t = first_wins(t, ["page_id", "raw_type", "label"], ["seq", "path"])
    choices = F.from_json(g("$.properties.choices"), "array<struct<label:string,ref:string>>")
    options = F.filter(F.transform(F.coalesce(choices, F.array().cast("array<struct<label:string,ref:string>>")), lambda x: F.coalesce(blank_to_null(x["label"]), x["ref"])), lambda o: txt(o) != "")
    mapped = chain([(F.col("raw_type") == k, v) for k, v in SCHEMA_TYPE_NAMES.items()], F.col("raw_type"))
    none = F.lit(None).cast("string")
    out = t.select(
        "page_id", "seq", "path", F.coalesce(g("$.ref"), g("$.id")).alias("name"), "label", mapped.alias("type"),
        F.coalesce(g("$.validations.required") == "true", F.lit(False)).alias("required"), options.alias("options"),
    )
    out = out.withColumn("purpose", field_purpose("name", none, "type", "label", none, none))
    return out.filter(~is_junk_field("name", "label", "type"))
