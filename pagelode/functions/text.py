"""Text functions: normalising, clipping, measuring, splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelode.functions.base import NOT_WS, WS, WS_CHARS, c, sub, txt

# Character references that occur in page copy.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "),
    ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&middot;", "·"), ("&bull;", "•"),
    ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&euro;", "€"), ("&pound;", "£"), ("&times;", "×"),
]


# Quotes decoded inside a tag would end its attributes early; they travel as these two
# private-use characters until the attribute value has been cut out.
QUOTE_MARKS = "\ue000\ue001"


def decode_entities(s: Column | str, in_tag: bool = False) -> Column:
    """Character references to characters, `&amp;` last; `&nbsp;` becomes a plain space."""
    s = c(s)
    double, single = QUOTE_MARKS if in_tag else "\"'"

    def numeric(piece: Column) -> Column:
        hexa = piece.rlike("^&#[xX]")
        digits = F.when(hexa, F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]+);", 1)).otherwise(
            F.regexp_extract(piece, "^&#([0-9]+);", 1)
        )
        code = F.when(hexa, F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        code = F.when(code == 160, F.lit(32)).when(code == 34, ord(double)).when(code == 39, ord(single)).otherwise(code)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        # A decoded ampersand must not start another reference.
        char = F.when(code == 38, F.lit("&amp;")).otherwise(char)
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(piece.rlike("^&#([0-9]+|[xX][0-9a-fA-F]+);$") & valid, char).otherwise(piece)

    pieces = F.regexp_extract_all(s, F.lit("&#[xX]?[0-9a-fA-F]+;|[^&]+|&"), F.lit(0))
    out = F.when(s.contains("&#"), F.array_join(F.transform(pieces, numeric), "")).otherwise(s)
    for name, char in ENTITIES:
        char = {"&quot;": double, "&apos;": single}.get(name, char)
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.when(s.contains("&"), F.replace(out, F.lit("&amp;"), F.lit("&"))).otherwise(s)


def strip(s: Column | str) -> Column:
    return F.regexp_replace(c(s), f"^{WS}+|{WS}+$", "")


def collapse(s: Column | str) -> Column:
    """Runs of white space become one space; ends trimmed."""
    return F.trim(F.regexp_replace(txt(c(s)), f"{WS}+", " "))


def clip(s: Column | str, n: int = 160, style: str = "ellipsis") -> Column:
    """Cut long text. `ellipsis`: n-1 characters and '…'; `dots`: n-3 characters and '...'."""
    s = c(s)
    keep, tail = (n - 1, "…") if style == "ellipsis" else (n - 3, "...")
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, keep), F.lit(tail))).otherwise(s)


def trim_quote(s: Column | str, n: int = 160) -> Column:
    """Collapsed, clipped and put in double quotes, as evidence lines show it."""
    return F.concat(F.lit('"'), clip(collapse(s), n), F.lit('"'))


_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def norm_label(s: Column | str) -> Column:
    """Key of a control label: lower case, no quotes, no leading or trailing punctuation."""
    low = F.regexp_replace(F.lower(txt(c(s))), "[‘’“”\"']", "")
    return F.trim(F.regexp_replace(F.regexp_replace(low, f"{WS}+", " "), _EDGES, ""))


def norm_msg(s: Column | str) -> Column:
    """Key of a message: collapsed, lower case, outer punctuation dropped."""
    return F.regexp_replace(F.lower(collapse(s)), _EDGES, "")


def words(s: Column | str) -> Column:
    return F.filter(F.split(txt(c(s)), f"{WS}+"), lambda w: w != "")


_WORD = f"{NOT_WS}+"


def word_count(s: Column | str) -> Column:
    return F.regexp_count(txt(c(s)), F.lit(_WORD))


def count_char(s: Column | str, char: str) -> Column:
    s = txt(c(s))
    return F.length(s) - F.length(F.replace(s, F.lit(char), F.lit("")))


def is_all_caps(s: Column | str) -> Column:
    t = strip(txt(c(s)))
    return (F.length(t) >= 8) & t.rlike("[A-Za-z]") & (t == F.upper(t))


def copy_metrics(s: Column | str) -> Column:
    """Word count, average sentence and word length (NULL under 20 words, one decimal).

    Averages are ratios of counts over the whole text, so no array of words is built.
    """
    text = txt(c(s))
    n = word_count(text)
    stop = rf"[.!?]+(?={WS}|\z)"
    spoken = word_count(F.regexp_replace(text, stop, " "))
    said = F.size(F.filter(F.split(text, stop), lambda p: p.rlike(_WORD)))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}'-]+", ""))
    named = word_count(F.regexp_replace(text, r"[^\p{L}\p{N}'\-" + WS_CHARS + "]+", ""))
    # Half up at one decimal, on the exact ratio.
    mean1 = lambda total, k: F.when((n >= 20) & (k > 0), F.floor(total * 10 / k + 0.5) / 10)
    return F.struct(
        n.alias("word_count"),
        F.length(text).alias("character_count"),
        mean1(spoken, said).alias("average_sentence_words"),
        mean1(letters, named).alias("average_word_characters"),
        count_char(text, "!").alias("exclamation_marks"),
        count_char(text, "?").alias("question_marks"),
    )


#: Where a sentence ends: after .!? before a start that is not lower case, and at | or •.
SENTENCE_END = r"(?<=[.!?])\s+(?=[^a-z])|\s*[|•]\s*"


def sentences(s: Column | str) -> Column:
    """Split after .!? before a non-lower-case start, and at | or •."""
    parts = F.split(collapse(s), SENTENCE_END)
    return F.filter(F.transform(parts, F.trim), lambda p: p != "")


def slugify(s: Column | str) -> Column:
    return sub(sub(F.lower(c(s)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def looks_like_item(s: Column | str) -> Column:
    t = collapse(s)
    return F.length(t).between(8, 120) & ~t.rlike(r"[.!?]\s+\S") & (word_count(t) <= 20)


def with_article(label: Column | str) -> Column:
    label = c(label)
    return F.concat(F.when(label.rlike("(?i)^[aeiou]"), F.lit("an ")).otherwise(F.lit("a ")), label)


