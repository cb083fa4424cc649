"""Small Column helpers every other module builds on."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \b looks at Unicode letters on some JDKs; the patterns here mean ASCII words.
_EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"

# White space as browsers see it. Java asks the members of a class one after the other, so the
# two ranges that hold all of them, or the one that holds most other characters, come first.
WS_CHARS = r"\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
WS = rf"[\x{{00}}-\x{{20}}\x{{a0}}-\x{{feff}}&&[{WS_CHARS}]]"
NOT_WS = (
    r"[!-\x{9f}\x{a1}-\x{167f}\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}\x{2030}-\x{205e}\x{2060}-\x{2fff}"
    r"\x{3001}-\x{fefe}\x{ff00}-\x{10ffff}\x{00}-\x{08}\x{0e}-\x{1f}]"
)

# One atom of a pattern: an escape, a class, the start of a group, or a character; and how often it stands.
_ATOM = re.compile(r"\\[xp]\{\w+\}|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?(?:[:=!>]|<[=!]|[a-z]+\))|.", re.S)
_TIMES = re.compile(r"(?:[*?+]|\{\d[\d,]*\})[?+]?")
_WORD_ATOM = re.compile(r"\\[dw]|[A-Za-z0-9_]|\[(?:\\[dw]|[a-z]-[a-z]|[A-Z]-[A-Z]|\d-\d|[A-Za-z0-9_])+\]")


def _edges(pattern: str, at: int, out: list[str]) -> tuple[int, bool, bool]:
    """Copy the alternatives from `at` to the end of their group, with word edges put simply.

    Next to what surely is a word character, an edge only asks for the other side. Returns where
    the group ends and whether all alternatives surely begin, and end, with a word character.
    """
    begin_all, end_all = True, True
    first, last, edge = None, False, None  # first: not known before an atom that must stand; edge: waits for it
    while at < len(pattern) and pattern[at] != ")":
        atom = _ATOM.match(pattern, at)[0]
        at += len(atom)
        if atom == "|":
            begin_all, end_all = begin_all and bool(first), end_all and last
            first, last, edge = None, False, None
            out.append(atom)
        elif atom == r"\b":
            edge = None if last else len(out)
            out.append(r"(?!\w)" if last else _EDGE)
            first, last = bool(first), False
        elif re.fullmatch(r"\(\?[a-z]+\)", atom):
            out.append(atom)
        else:
            begins = ends = bool(_WORD_ATOM.fullmatch(atom))
            out.append(atom)
            if atom[0] == "(":
                at, begins, ends = _edges(pattern, at, out)
                begins, ends = (x and atom in ("(", "(?:") for x in (begins, ends))
                out.append(pattern[at])
                at += 1
            times = _TIMES.match(pattern, at)
            out.append(times[0] if times else "")
            at += len(out[-1])
            optional = bool(times) and (times[0][0] in "*?" or times[0].startswith("{0"))
            if edge is not None and begins and not optional:
                out[edge] = r"(?<!\w)"
            if not (begins and optional):
                edge, first = None, begins if first is None else first
            last = ends and (last or not optional)
    return at, begin_all and bool(first), end_all and last


@lru_cache(None)
def rx(pattern: str) -> str:
    """A portable pattern as Java should run it."""
    if r"\b" not in pattern:
        return pattern
    out: list[str] = []
    end, _, _ = _edges(pattern, 0, out)
    assert end == len(pattern), pattern
    return "".join(out)


def c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def has(s: Column | str, pattern: str) -> Column:
    """True when the pattern occurs; NULL text never matches."""
    return F.coalesce(c(s).rlike(rx(pattern)), F.lit(False))


def ext(s: Column | str, pattern: str, group: int = 0) -> Column:
    """First match of a group, NULL when absent or empty."""
    return F.nullif(F.regexp_extract(c(s), rx(pattern), group), F.lit(""))


def ext_all(s: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c(s), F.lit(rx(pattern)), F.lit(group))


def sub(s: Column | str, pattern: str, to: str) -> Column:
    return F.regexp_replace(c(s), rx(pattern), to)


def cut(s: Column, n: int) -> Column:
    return F.substring(s, 1, n)


def blank_to_null(s: Column) -> Column:
    return F.nullif(s, F.lit(""))


def txt(s: Column) -> Column:
    return F.coalesce(s, F.lit(""))


def cat(*parts: Column | str) -> Column:
    """String concatenation; plain Python strings are literals here."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def chain(cases: list[tuple[Column, str]], default: Column | None = None) -> Column:
    """Ordered decision list: the first true condition names the result."""
    out = None
    for cond, value in cases:
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(default if default is not None else F.lit(None).cast("string"))


def match_pos(s: Column, pattern: str) -> Column:
    """1-based position of the first match, NULL without one."""
    hit = F.regexp_instr(s, F.lit(rx(pattern)))
    return F.when(hit > 0, hit)


def around(s: Column, pos: Column, length: Column, radius: int) -> Column:
    """Text within radius characters of a match at a 1-based position."""
    start = F.greatest(F.lit(1), pos - radius)
    return F.substring(s, start, pos + length + radius - start)


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times inside `body`.

    Column builders copy their arguments into every use, so a value read ten times by an
    expression that is itself read ten times would be planned a hundred times.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
