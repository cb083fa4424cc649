"""Markup to tokens, element extents and page text, as one distributed job.

Layout: the raw page rows are hash-partitioned on `page_id` once, before they are
exploded. Every window and join below keys on `page_id`, so tokens (about forty
times as many rows as pages) never cross the network, and a `pages` table bucketed on
`page_id` needs no exchange at all. No group is larger than one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelode.functions.base import WS, c
from pagelode.functions.text import QUOTE_MARKS, collapse, decode_entities

# A tag to its end; a '>' inside a quoted value does not end it.
TAG = r"<[a-zA-Z/](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
# One token: comment, raw-text element with its body, tag (one with unbalanced quotes to the
# first '>'), text run, or a stray '<'.
TOKEN_RE = (
    r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
    rf"|<textarea\b.*?(?:</textarea\s*>|\z)|{TAG}|<[a-z/!][^>]*>|[^<]+|<"
)

# HTML element classes.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
BLOCK = [
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
]
HIDDEN_TAGS = ["head", "title", "template", "noscript"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]


def _before():
    return W.partitionBy("page_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)


def _so_far():
    return W.partitionBy("page_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)


def _until(name: str) -> str:
    """From the start of a tag to the end of its first attribute of that name.

    Other attributes are stepped over whole, so a name inside a quoted value is never found.
    """
    here = rf"{name}(?=[\s=/>]|$)"
    other = rf"(?!{here})[^\s\"'>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?"
    return rf"(?is)^<[a-z][^\s/>]*(?:[\s/]+(?:{other})|[\"'=])*[\s/]+{here}"


def _named(head: Column, name: str) -> Column:
    """Whether the name stands in the tag at all; most tags need no pattern after that."""
    return F.lower(head).contains(name)


def attr(head: Column | str, name: str) -> Column:
    """Attribute value: double-quoted, single-quoted or bare; NULL when absent."""
    raw = F.regexp_extract(c(head), _until(name) + r"\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    value = F.translate(F.regexp_replace(F.nullif(raw, F.lit("")), "^[\"']|[\"']$", ""), QUOTE_MARKS, "\"'")
    return F.when(_named(c(head), name), value)


def has_attr(tag_text: Column | str, name: str) -> Column:
    return _named(c(tag_text), name) & c(tag_text).rlike(_until(name))


#: Bytes of markup in a partition, about; sorted tokens of a page take some forty times its markup.
PARTITION_BYTES = 16 << 20


def partitions_of(pages: DataFrame) -> int:
    """Partitions that hold about `PARTITION_BYTES` of markup each, at least the session's number."""
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    return max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))


def partition_pages(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """The only exchange of the extraction job.

    Markup grows many times as it is taken apart, so partitions that are joined up by the size
    of the exchange outgrow a task; a stated number of them is kept.
    """
    rows = pages.select("page_id", "url", "html")
    return rows.repartition(parts, "page_id") if parts else rows.repartition("page_id")


def tokens(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """(page_id, seq, tok, kind, tag): the document in order, nothing lost."""
    tok = F.col("tok")
    kind = (
        F.when(tok.startswith("<!--"), "comment")
        .when(tok.rlike(r"(?i)^<(script|style|textarea)\b"), "raw")
        .when(tok.rlike("^</[a-zA-Z]"), "close")
        .when(tok.rlike("^<[a-zA-Z]"), "open")
        .when(tok.rlike("^<[/!]"), "decl")
        .otherwise("text")
    )
    tag = F.when(
        F.col("kind").isin("raw", "open", "close"),
        F.lower(F.regexp_extract(tok, "^</?([a-zA-Z][a-zA-Z0-9:_-]*)", 1)),
    )
    pieces = F.regexp_extract_all("html", F.lit(TOKEN_RE), F.lit(0))
    return (
        partition_pages(pages, parts)
        .select("page_id", F.posexplode(pieces).alias("seq", "tok"))
        .withColumn("kind", kind)
        .withColumn("tag", tag)
    )


def nodes(toks: DataFrame) -> DataFrame:
    """Tokens with text offsets, element extents and the regions they lie in.

    `off`/`end_off` are positions in the page's text, so the text of any element is one
    substring; `end_seq` is the token that closes it (implied ends for p and option).
    Regions use a running maximum of extents, which tolerates overlap and stray closes.
    """
    # The windows sort rows several times, so only the token itself goes through them; what is
    # read from its decoded forms beforehand is a length and a few flags.
    head = F.when(F.col("kind") == "raw", decode_entities(F.regexp_extract("tok", rf"^(?:{TAG}|<[^>]*>)", 0), in_tag=True)).when(
        F.col("kind") == "open", decode_entities("tok", in_tag=True)
    )
    txt = F.when(F.col("kind") == "text", decode_entities("tok")).otherwise(F.lit(""))
    opens = (F.col("kind") == "open") & ~F.col("tag").isin(VOID) & ~F.col("tok").endswith("/>")
    given = lambda name: F.lower(attr("head", name))
    t = toks.withColumn("head", head).select(
        "page_id", "seq", "tok", "kind", "tag", opens.alias("opens"), F.length(txt).alias("n_txt"),
        given("role").alias("role"), given("class").alias("cls"), given("id").alias("ident"), given("style").alias("style"),
        F.coalesce(has_attr("head", "hidden"), F.lit(False)).alias("is_hidden"),
        F.when(F.col("tag") == "input", given("type")).alias("type"),
    )
    role, style = F.coalesce("role", F.lit("")), F.coalesce("style", F.lit(""))
    names = F.concat_ws(" ", "cls", "ident")
    unseen = style.rlike(r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(\.0+)?\s*(;|$)")
    t = t.select(
        "page_id", "seq", "tok", "kind", "tag", "opens", "n_txt",
        (F.col("is_hidden") | unseen).alias("own_hidden"),
        (F.coalesce("type", F.lit("")) == "hidden").alias("hidden_input"),
        (F.col("tag").isin("nav", "header") | (role == "navigation")).alias("is_nav"),
        ((F.col("tag") == "footer") | (role == "contentinfo")).alias("is_footer"),
        ((F.col("tag") == "dialog") | (role == "dialog") | names.rlike("modal|popup")).alias("is_modal"),
    )

    step = F.when(F.col("opens"), 1).when(F.col("kind") == "close", -1).otherwise(0)
    depth = F.sum(step).over(W.partitionBy("page_id", "tag").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    t = t.withColumn("off", F.coalesce(F.sum("n_txt").over(_before()), F.lit(0)).cast("int"))
    t = t.withColumn("lvl", depth + F.when(F.col("kind") == "close", 1).otherwise(0))

    mark = F.struct("seq", "off")
    t = t.withColumn("mark", mark)
    pair = F.expr(
        "lead(CASE WHEN kind = 'close' THEN mark END) IGNORE NULLS "
        "OVER (PARTITION BY page_id, tag, lvl ORDER BY seq)"
    )
    t = t.withColumn("pair", F.when(F.col("opens"), pair))

    ends_p = F.col("tag").isin([b for b in BLOCK]) & F.col("kind").isin("open", "close")
    ends_option = F.col("tag").isin("option", "optgroup", "select") & F.col("kind").isin("open", "close")
    t = t.withColumn("ends_p", ends_p).withColumn("ends_option", ends_option)
    over = "OVER (PARTITION BY page_id ORDER BY seq)"
    t = t.withColumn("next_p", F.expr(f"lead(CASE WHEN ends_p THEN mark END) IGNORE NULLS {over}"))
    t = t.withColumn("next_option", F.expr(f"lead(CASE WHEN ends_option THEN mark END) IGNORE NULLS {over}"))
    whole = W.partitionBy("page_id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    last = F.last(F.struct((F.col("seq") + 1).alias("seq"), (F.col("off") + F.col("n_txt")).alias("off"))).over(whole)
    end = (
        F.when(F.col("tag") == "p", F.col("next_p"))
        .when(F.col("tag") == "option", F.col("next_option"))
        .otherwise(F.col("pair"))
    )
    t = t.withColumn("end", F.when(F.col("opens"), F.coalesce(end, last)).otherwise(F.when(F.col("kind").isin("open", "raw"), F.col("mark"))))
    t = t.withColumn("end_seq", F.col("end.seq")).withColumn("end_off", F.col("end.off"))

    hides = F.col("opens") & (F.col("tag").isin(HIDDEN_TAGS) | F.col("own_hidden"))

    def region(cond: Column) -> Column:
        return F.max(F.when(F.col("opens") & cond, F.col("end_seq"))).over(_so_far())

    def holder(name: str) -> Column:
        mine = F.when((F.col("tag") == name) & F.col("opens"), F.struct("seq", "end_seq"))
        return F.last(mine, ignorenulls=True).over(_before())

    inside = lambda col: F.coalesce(F.col(col) > F.col("seq"), F.lit(False))
    t = t.select(
        "*",
        region(hides).alias("r_hidden"), region(F.col("is_nav")).alias("r_nav"), region(F.col("is_footer")).alias("r_footer"),
        region(F.col("is_modal")).alias("r_modal"), holder("form").alias("h_form"), holder("label").alias("h_label"),
        holder("select").alias("h_select"),
    )
    owner = lambda col: F.when(F.col(f"{col}.end_seq") > F.col("seq"), F.col(f"{col}.seq"))
    return t.select(
        "page_id", "seq", "tok", "kind", "tag", head.alias("head"), txt.alias("txt"), "off", "end_seq", "end_off",
        (inside("r_hidden") | F.col("hidden_input") | F.col("own_hidden")).alias("hidden"),
        inside("r_nav").alias("in_nav"), inside("r_footer").alias("in_footer"), inside("r_modal").alias("in_modal"),
        owner("h_form").alias("form_seq"), owner("h_label").alias("label_seq"), owner("h_select").alias("select_seq"),
    )


def page_texts(nds: DataFrame) -> DataFrame:
    """(page_id, full_text, visible_text): raw text for slicing, and copy as a visitor reads it."""
    block = F.col("tag").isin(BLOCK) | (F.col("tag") == "br")
    shown = (
        F.when((F.col("kind") == "text") & ~F.col("hidden"), F.regexp_replace("txt", f"{WS}+", " "))
        .when(F.col("kind").isin("open", "close") & block, F.lit("\n"))
        .otherwise(F.lit(""))
    )
    rows = nds.withColumn("shown", shown).filter((F.col("txt") != "") | (F.col("shown") != ""))
    listed = rows.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "txt", "shown"))).alias("l")
    )
    shown_all = F.array_join(F.transform("l", lambda x: x["shown"]), "")
    tidy = F.regexp_replace(F.regexp_replace(shown_all, " +", " "), r" ?\n[ \n]*", "\n")
    return listed.select(
        "page_id",
        F.array_join(F.transform("l", lambda x: x["txt"]), "").alias("full_text"),
        F.regexp_replace(tidy, r"^[ \n]+|[ \n]+$", "").alias("visible_text"),
    )


def list_items(nds: DataFrame) -> DataFrame:
    """`li` elements with their real ends: next item or end of the same list."""
    t = nds.filter(F.col("tag").isin("li", "ul", "ol") & F.col("kind").isin("open", "close"))
    is_list = F.col("tag") != "li"
    step = F.when(is_list & (F.col("kind") == "open"), 1).when(is_list, -1).otherwise(0)
    run = F.sum(step).over(_so_far())
    floor = F.min("run").over(_so_far())
    t = t.withColumn("run", run).withColumn("depth", F.col("run") - F.least(floor, F.lit(0)))
    key = F.when(~is_list, F.col("depth")).when(F.col("kind") == "close", F.col("depth") + 1)
    t = t.withColumn("lkey", key).filter(F.col("lkey").isNotNull())
    nxt = F.lead(F.struct("seq", "off")).over(W.partitionBy("page_id", "lkey").orderBy("seq"))
    t = t.withColumn("nxt", nxt).filter((F.col("tag") == "li") & (F.col("kind") == "open"))
    return t.withColumn("end_seq", F.coalesce("nxt.seq", "end_seq")).withColumn(
        "end_off", F.coalesce("nxt.off", "end_off")
    ).drop("run", "depth", "lkey", "nxt")


#: Characters of one piece of a page's text.
PIECE = 4096


def text_pieces(texts: DataFrame) -> DataFrame:
    """(page_id, piece, part): the page text in pieces of equal length."""
    return texts.select("page_id", F.posexplode(F.regexp_extract_all("full_text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("piece", "part"))


def with_text(elements: DataFrame, pieces: DataFrame, name: str = "text") -> DataFrame:
    """Attach element text, cut from the pieces of the page text that the element touches.

    An element moves its own text and a piece at either end, never the page's whole text.
    """
    first, last = F.floor(F.col("off") / PIECE).cast("int"), F.floor(F.greatest(F.col("off"), F.coalesce("end_off", "off") - 1) / PIECE).cast("int")
    own = F.struct(*elements.columns)
    spread = elements.select("page_id", "seq", own.alias("own"), first.alias("first"), F.explode(F.sequence(first, last)).alias("piece"))
    met = spread.join(pieces, ["page_id", "piece"], "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "part"))), lambda x: x["part"]), "")
    whole = met.groupBy("page_id", "seq").agg(F.first("own").alias("own"), F.first("first").alias("first"), text.alias("run"))
    sliced = F.expr(f"substring(run, own.off - first * {PIECE} + 1, greatest(coalesce(own.end_off, own.off) - own.off, 0))")
    return whole.select("own.*", collapse(F.coalesce(sliced, F.lit(""))).alias(name))


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def numbered(df: DataFrame, name: str, order, keys=("page_id",)) -> DataFrame:
    """0-based position within the page."""
    return df.withColumn(name, (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))


