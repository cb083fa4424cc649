"""Line dedup by site-relative frequency, in DataFrame functions throughout.

Lines are grouped by host; the pages of a host that contain a line, divided by the pages of that
host, give the line's ratio. Lines above `ratio` are boilerplate, at every size of a host (a caller may ask for `min_pages` besides), and
leave every page of the host.

Lines travel as 128-bit digests and are counted once a page, so a line costs a few bytes in the
shuffle and counts are combined before it. The boilerplate of a host is a short list: its lines
have more than `ratio` x pages occurrences each, so there are fewer than 1 / ratio times the mean
number of lines of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm.shared import Scratch

#: Boilerplate lines of all hosts together up to which the lists are broadcast (about 20 MB).
BROADCAST_LINES = 400_000
#: Parts that a host's pages are dealt into where the lists are too large for that.
SALTS = 64


def digest(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line)))


def boilerplate(df: DataFrame, ratio: float, min_pages: int, text: str, host: str) -> DataFrame:
    """(host, line digest) of lines on more than `ratio` of the host's pages. Blank lines never count."""
    pages = df.select(F.col(host).alias("host"), F.split(text, "\n").alias("lines")).filter("host IS NOT NULL")
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    keys = F.array_distinct(F.transform(F.filter("lines", lambda x: F.trim(x) != ""), digest))
    counts = pages.select("host", F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    return counts.join(totals, "host").filter(F.col("n") > F.col("total") * ratio).select("host", "line")


def dedup(df: DataFrame, scratch: Scratch, ratio: float = 0.1, min_pages: int = 1, text: str = "text", host: str = "source") -> DataFrame:
    """`df` with boilerplate lines gone from `text`, plus n_lines and n_dropped (ints).

    On a host of so few pages that one of them is above the ratio every line goes. A page on which a line repeats counts once and loses all its repeats. Rows without host are
    kept as they are, and so are null texts (0 lines). Repeated rows count as pages of their own.
    Other columns pass through; n_lines and n_dropped replace columns of those names.
    """
    df = df.drop("n_lines", "n_dropped")
    found = scratch.cut(boilerplate(df, ratio, min_pages, text, host))
    lists = found.groupBy(F.col("host").alias("__host")).agg(F.collect_set("line").alias("__drop"))
    if found.count() <= BROADCAST_LINES:
        joined = df.join(F.broadcast(lists), F.col(host) == F.col("__host"), "left")
    else:
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(text), F.lit(SALTS)))
        copies = lists.withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(copies, (F.col(host) == F.col("__host")) & (F.col("__salt") == F.col("__s")), "left").drop("__salt", "__s")
    lines = F.split(text, "\n")
    kept = F.when(F.col("__drop").isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__drop"), digest(x))))
    joined = joined.withColumn("__kept", kept)
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    out = joined.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(n_lines)).withColumn("n_dropped", F.when(F.col(text).isNull(), 0).otherwise(n_lines - F.size("__kept")))
    return out.withColumn(text, F.array_join("__kept", "\n")).select(*df.columns, "n_lines", "n_dropped")


#: What ends a line in a page, as tags.
BLOCK_TAGS = "p|div|li|ul|ol|h1|h2|h3|h4|h5|h6|article|section|nav|header|footer|aside|main|table|tr|td|th|br|hr|title|head|body|html|blockquote|pre|form|dl|dt|dd|figure|option|button"


def page_lines(html: Column) -> Column:
    """Visible text of a page, one line per block, blank lines left out."""
    x = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)\s*>", "")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", "")
    x = F.regexp_replace(x, rf"(?i)</?({BLOCK_TAGS})(\s[^>]*)?>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    return F.array_join(F.filter(F.transform(F.split(x, "\n"), lambda y: F.trim(y)), lambda y: y != ""), "\n")


def host_of(url: Column) -> Column:
    """Host of an absolute URL in lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/:?#]+)", 2)), F.lit(""))
