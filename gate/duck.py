"""DuckDB side of the correctness gate: helpers and shared CTEs, written in plain SQL."""

from __future__ import annotations

from gate.corpus import LANDING_SQL, ROW_PX
from pagelode.functions import text as T
from pagelode.operators import markup as M

WSC = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def s(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def lst(values) -> str:
    return "(" + ", ".join(s(v) for v in values) + ")"


def has(col: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({col}, {s(pattern)}), false)"


def ext(col: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({col}, {s(pattern)}, {group}), '')"


def rep(col: str, pattern: str, to: str) -> str:
    return f"regexp_replace({col}, {s(pattern)}, {s(to)}, 'g')"


def collapse(col: str) -> str:
    return f"trim({rep(f'coalesce({col}, {s('')})', WSC + '+', ' ')}, ' ')"


def clip(col: str, n: int = 160, style: str = "ellipsis") -> str:
    keep, tail = (n - 1, "…") if style == "ellipsis" else (n - 3, "...")
    return f"CASE WHEN length({col}) > {n} THEN substr({col}, 1, {keep}) || {s(tail)} ELSE {col} END"


def decode(col: str) -> str:
    out = col
    for name, char in T.ENTITIES:
        out = f"replace({out}, {s(name)}, {s(char)})"
    return f"replace({out}, '&amp;', '&')"


# Attributes of a tag as a list of name=value pairs, quotes respected; looked up by lower-case name.
PAIR = r"""[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""


def _pair(name: str, head: str) -> str:
    inside = f"regexp_replace({head}, '^<[A-Za-z][^\\s/>]*', '')"
    return f"list_filter(regexp_extract_all({inside}, {s(PAIR)}), lambda p: lower(regexp_extract(p, '^[^\\s=]+', 0)) = {s(name)})[1]"


def attr(name: str, head: str = "head") -> str:
    value = f"regexp_extract({_pair(name, head)}, '(?s)=\\s*(.*)$', 1)"
    inner = f"regexp_replace({value}, {s('''^["']|["']$''')}, '', 'g')"
    return f"CASE WHEN {value} <> '' THEN {decode(inner)} END"


def hasattr_(name: str, head: str = "head") -> str:
    return f"({_pair(name, head)} IS NOT NULL)"


def norm_label(col: str) -> str:
    a = rep(f"lower(coalesce({col}, ''))", "[‘’“”\"']", "")
    b = rep(a, WSC + "+", " ")
    return f"trim({rep(b, r'^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '')}, ' ')"


def norm_msg(col: str) -> str:
    return rep(f"lower({collapse(col)})", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def word_count(col: str) -> str:
    return f"len(list_filter(regexp_split_to_array(coalesce({col}, ''), {s(WSC + '+')}), lambda w: w <> ''))"


def chain(cases, default="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {s(v)}" for c, v in cases) + f" ELSE {default} END"


# ------------------------------------------------------------------ urls

def scheme(u):
    return f"lower(nullif(regexp_extract({u}, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1), ''))"


def host(u):
    return (
        f"nullif(regexp_replace(regexp_replace(lower(regexp_extract({u}, {s('^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)')}, 1)), '^.*@', ''), ':[0-9]*$', ''), '')"
    )


def upath(u):
    p = f"regexp_extract({u}, {s('^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)')}, 1)"
    return f"CASE WHEN {p} = '' THEN '/' ELSE {p} END"


def uquery(u):
    return f"regexp_extract({u}, {s('^[^?#]*([?][^#]*)')}, 1)"


def origin(u):
    return f"({scheme(u)} || '://' || {host(u)})"


def docurl(u):
    return f"({origin(u)} || {upath(u)} || {uquery(u)})"


def fold(p):
    a = f"regexp_replace({p}, {s('/(?:[.]/)+')}, '/', 'g')"
    for _ in range(3):
        a = f"regexp_replace({a}, {s('/[^/.][^/]*/[.][.](/|$)')}, '/')"
    return f"regexp_replace({a}, {s('^/(?:[.][.]/)+')}, '/')"


def resolve(h, base):
    path = f"regexp_extract({h}, '^([^?#]*)', 1)"
    rest = f"regexp_extract({h}, '^[^?#]*(.*)$', 1)"
    return (
        f"CASE WHEN regexp_matches({h}, '^[hH][tT][tT][pP][sS]?://') THEN {origin(h)} || {fold(upath(h))} || {uquery(h)} || regexp_extract({h}, '(#.*)$', 1) "
        f"WHEN regexp_matches({h}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {h} "
        f"WHEN {h} = '' THEN {docurl(base)} WHEN {h}[1] = '#' THEN {docurl(base)} || {h} "
        f"WHEN {h}[1] = '?' THEN {origin(base)} || {upath(base)} || {h} "
        f"WHEN {h}[1:2] = '//' THEN {scheme(base)} || ':' || {h} "
        f"WHEN {h}[1] = '/' THEN {origin(base)} || {fold(path)} || {rest} "
        f"ELSE {origin(base)} || {fold(f'(regexp_extract({upath(base)}, {s('^(.*/)[^/]*$')}, 1) || {path})')} || {rest} END"
    )


SECOND = "('co','com','net','org','gov','edu','ac','or','ne','gob','govt','asn')"


def registrable(h):
    parts = f"string_split({h}, '.')"
    return (
        f"CASE WHEN {h} IS NULL THEN '' WHEN regexp_matches({h}, {s('^[0-9]{1,3}([.][0-9]{1,3}){3}$')}) THEN {h} WHEN len({parts}) <= 2 THEN {h} "
        f"WHEN {parts}[-2] IN {SECOND} THEN array_to_string({parts}[-3:], '.') ELSE array_to_string({parts}[-2:], '.') END"
    )


# ------------------------------------------------------------------ shared CTEs

_HIDE_STYLE = r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(\.0+)?\s*(;|$)"
_BLOCKS = lst(M.BLOCK)
# A tag ends at the first '>' outside quotes, or at the first one where quotes do not pair.
OPEN_TAG = r"""<[A-Za-z/](?:[^>"']|"[^"]*"|'[^']*')*>"""
TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<textarea\b.*?(?:</textarea\s*>|\z)"
    rf"|{OPEN_TAG}|<[a-z/!][^>]*>|[^<]+|<"
)


def _nodes(src: str) -> str:
    void = lst(M.VOID)
    return f"""
raw0 AS (SELECT page_id, regexp_extract_all(html, {s(TOKEN)}) toks FROM {src}),
tk0 AS (SELECT page_id, CAST(i - 1 AS INTEGER) seq, toks[i] tok FROM (SELECT page_id, toks, unnest(range(1, len(toks) + 1)) i FROM raw0)),
tk AS (SELECT *, CASE WHEN kind IN ('raw','open','close') THEN lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9:_-]*)', 1)) END tag
  FROM (SELECT *, CASE WHEN tok[1:4] = '<!--' THEN 'comment' WHEN regexp_matches(tok, '(?i)^<(script|style|textarea)\\b') THEN 'raw'
    WHEN regexp_matches(tok, '^</[a-zA-Z]') THEN 'close' WHEN regexp_matches(tok, '^<[a-zA-Z]') THEN 'open'
    WHEN regexp_matches(tok, '^<[/!]') THEN 'decl' ELSE 'text' END kind FROM tk0)),
n1 AS (SELECT *, CASE kind WHEN 'raw' THEN regexp_extract(tok, {s('(?s)^(?:' + OPEN_TAG + '|<[^>]*>)')}, 0) WHEN 'open' THEN tok END head,
    CASE WHEN kind = 'text' THEN {decode('tok')} ELSE '' END txt,
    kind = 'open' AND tag NOT IN {void} AND tok NOT LIKE '%/>' opens FROM tk),
n2 AS (SELECT *, sum(CASE WHEN opens THEN 1 WHEN kind = 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id, tag ORDER BY seq) d FROM n1),
n3 AS (SELECT *, min(CASE WHEN kind = 'close' THEN seq END) OVER (PARTITION BY page_id, tag, d + CASE WHEN kind = 'close' THEN 1 ELSE 0 END ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) pair,
    min(CASE WHEN kind IN ('open','close') AND tag IN {_BLOCKS} THEN seq END) OVER (PARTITION BY page_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) np,
    min(CASE WHEN kind IN ('open','close') AND tag IN ('option','optgroup','select') THEN seq END) OVER (PARTITION BY page_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) nopt,
    max(seq) OVER (PARTITION BY page_id) + 1 eop FROM n2),
n4 AS (SELECT *, CASE WHEN opens THEN coalesce(CASE tag WHEN 'p' THEN np WHEN 'option' THEN nopt ELSE pair END, eop) WHEN kind IN ('open','raw') THEN seq END end_seq,
    lower(coalesce({attr('role')}, '')) role, lower(coalesce({attr('class')}, '') || ' ' || coalesce({attr('id')}, '')) names,
    lower(coalesce({attr('style')}, '')) style FROM n3),
n5 AS (SELECT *, coalesce({hasattr_('hidden')} OR regexp_matches(style, {s(_HIDE_STYLE)}), false) own_hidden,
    max(CASE WHEN opens AND (tag IN ('head','title','template','noscript') OR {hasattr_('hidden')} OR regexp_matches(style, {s(_HIDE_STYLE)})) THEN end_seq END) OVER w r_hidden,
    max(CASE WHEN opens AND (tag IN ('nav','header') OR role = 'navigation') THEN end_seq END) OVER w r_nav,
    max(CASE WHEN opens AND (tag = 'footer' OR role = 'contentinfo') THEN end_seq END) OVER w r_footer,
    max(CASE WHEN opens AND (tag = 'dialog' OR role = 'dialog' OR regexp_matches(names, 'modal|popup')) THEN end_seq END) OVER w r_modal,
    last_value(CASE WHEN opens AND tag = 'form' THEN struct_pack(a := seq, b := end_seq) END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) hf,
    last_value(CASE WHEN opens AND tag = 'select' THEN struct_pack(a := seq, b := end_seq) END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) hs,
    last_value(CASE WHEN opens AND tag = 'label' THEN struct_pack(a := seq, b := end_seq) END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) hl
    FROM n4 WINDOW w AS (PARTITION BY page_id ORDER BY seq)),
nd AS MATERIALIZED (SELECT page_id, seq, tok, kind, tag, head, txt, opens, end_seq, coalesce(r_nav > seq, false) in_nav, coalesce(r_footer > seq, false) in_footer,
    coalesce(r_modal > seq, false) in_modal, own_hidden OR coalesce(r_hidden > seq, false) OR (coalesce(tag, '') = 'input' AND lower(coalesce({attr('type')}, '')) = 'hidden') hidden,
    CASE WHEN hf.b > seq THEN hf.a END form_seq, CASE WHEN hs.b > seq THEN hs.a END select_seq, CASE WHEN hl.b > seq THEN hl.a END label_seq FROM n5),
tx AS MATERIALIZED (SELECT page_id, seq, txt FROM nd WHERE txt <> '')"""


def textof(cte: str, where: str, src: str = "nd", extra: str = "") -> str:
    """CTE of elements with their text: text tokens inside the extent, in order."""
    return f"""{cte}_e AS (SELECT * {extra} FROM {src} WHERE {where}),
{cte} AS MATERIALIZED (SELECT e.*, {collapse('t.tt')} "text" FROM {cte}_e e LEFT JOIN (SELECT e.page_id, e.seq, string_agg(x.txt, '' ORDER BY x.seq) tt FROM {cte}_e e JOIN tx x ON x.page_id = e.page_id AND x.seq > e.seq AND x.seq < e.end_seq GROUP BY ALL) t ON t.page_id = e.page_id AND t.seq = e.seq)"""


FOLD = f"CASE WHEN hidden THEN 'unknown' WHEN seq * {ROW_PX} < 900 THEN 'above_fold' ELSE 'below_fold' END"
NO_FOLD = "'unknown'"

_LI = """
li1 AS (SELECT page_id, seq, kind, tag, hidden, in_nav, in_footer, in_modal, head, end_seq, sum(CASE WHEN tag = 'li' THEN 0 WHEN kind = 'open' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY seq) ld
  FROM nd WHERE tag IN ('li','ul','ol') AND kind IN ('open','close')),
li2 AS (SELECT *, ld + CASE WHEN tag <> 'li' AND kind = 'close' THEN 1 ELSE 0 END k FROM li1 WHERE tag = 'li' OR kind = 'close'),
li3 AS (SELECT * EXCLUDE (end_seq, k, ld), coalesce(lead(seq) OVER (PARTITION BY page_id, k ORDER BY seq), end_seq) end_seq FROM li2),
blsrc AS (SELECT page_id, seq, tag, hidden, end_seq FROM li3 WHERE tag = 'li' AND kind = 'open' UNION ALL
  SELECT page_id, seq, tag, hidden, end_seq FROM nd WHERE kind = 'open' AND (tag IN ('p','blockquote') OR (tag <> 'li' AND regexp_matches(coalesce(%s, ''), 'subtitle|subhead')))),
blcap AS (SELECT * FROM blsrc)""" % attr("class")


class Ctx:
    """Builds `WITH ...` prefixes; asks only for the CTEs a query reads."""

    def __init__(self, source: str = "lp", layout: bool = True):
        self.source, self.layout = source, layout
        self.parts: list[tuple[str, str]] = []

    @property
    def pos(self) -> str:
        return FOLD if self.layout else NO_FOLD

    @property
    def y(self) -> str:
        return f"CAST(seq * {ROW_PX} AS INTEGER)" if self.layout else "CAST(NULL AS INTEGER)"

    def base(self) -> str:
        src = f"lp AS MATERIALIZED ({LANDING_SQL})" if self.source == "lp" else "lp AS (SELECT page_id, url, html FROM pages)"
        return src + "," + _nodes("lp")

    def cte(self, name: str) -> str:
        pos, y = self.pos, self.y
        if name == "hd_all":
            return textof("hx", "kind = 'open' AND tag IN ('h1','h2','h3','h4','h5','h6')") + f""",
hd_all AS MATERIALIZED (SELECT page_id, seq, CAST(tag[2] AS INTEGER) AS level, "text", NOT hidden visible, {pos} AS position, {y} y FROM hx)"""
        if name == "hd":
            return "hd AS (SELECT * FROM hd_all WHERE \"text\" <> '')"
        if name == "bl":
            return _LI + "," + textof("bx", "true", "blcap") + f""",
bl_all AS (SELECT page_id, seq, tag, "text", NOT hidden visible, {pos} AS position, {y} y FROM bx),
bl AS MATERIALIZED (SELECT page_id, seq, "text", visible, position, y FROM bl_all WHERE length("text") > 1)"""
        if name == "bt":
            src = f"(SELECT * FROM nd WHERE kind = 'open' AND (tag IN ('a','button') OR (tag = 'input' AND lower(coalesce({attr('type')}, '')) IN ('submit','button')) OR coalesce({attr('role')}, '') = 'button'))"
            label = f"CASE WHEN tag = 'input' THEN {attr('value')} ELSE coalesce(nullif(\"text\", ''), {attr('aria-label')}) END"
            return textof("bb", "true", src) + f""",
bt AS MATERIALIZED (SELECT b.page_id, seq, {collapse(label)} AS "text", tag, {attr('type')} AS "type", {resolve('rh', 'url')} AS href, NOT hidden visible, {pos} AS position, {y} y
  FROM (SELECT *, nullif({attr('href')}, '') rh FROM bb) b JOIN (SELECT page_id, url FROM lp) u ON u.page_id = b.page_id),
bt2 AS (SELECT * FROM bt WHERE "text" <> '' OR href IS NOT NULL)"""
        if name == "ln":
            src = f"(SELECT * FROM nd WHERE kind = 'open' AND tag = 'a' AND {hasattr_('href')})"
            return textof("lx", "true", src) + f""",
ln AS MATERIALIZED (SELECT l.page_id, seq, "text", raw_href, {resolve('raw_href', 'url')} AS href, NOT hidden visible, {pos} AS position, in_nav, in_footer, {y} y, url
  FROM (SELECT *, {attr('href')} raw_href FROM lx) l JOIN (SELECT page_id, url FROM lp) u ON u.page_id = l.page_id)"""
        if name == "sc":
            body = f"regexp_extract(tok, {s('(?is)^(?:' + OPEN_TAG + r'|<[^>]*>)(.*?)(?:</script\s*>)?\z')}, 1)"
            flat = rep(body, WSC + "+", " ")
            return f"""sc AS MATERIALIZED (SELECT n.page_id, seq, src, {host(resolve("nullif(src, '')", 'url'))} AS host, nullif(flat, '') inline_snippet, url FROM (
  SELECT *, CASE WHEN coalesce(src, '') = '' THEN {flat} END flat FROM (SELECT *, {attr('src')} src FROM nd WHERE kind = 'raw' AND tag = 'script')) n JOIN (SELECT page_id, url FROM lp) u ON u.page_id = n.page_id)"""
        if name == "vt":
            shown = (
                f"CASE WHEN kind = 'text' AND NOT hidden THEN {rep('txt', WSC + '+', ' ')} "
                f"WHEN kind IN ('open','close') AND (tag IN {_BLOCKS} OR tag = 'br') THEN chr(10) ELSE '' END"
            )
            agg = f"string_agg({shown}, '' ORDER BY seq)"
            tidy = f"regexp_replace(regexp_replace({agg}, ' +', ' ', 'g'), {s(' ?\n[ \n]*')}, chr(10), 'g')"
            return f"vt AS MATERIALIZED (SELECT page_id, regexp_replace({tidy}, {s('^[ \n]+|[ \n]+$')}, '', 'g') visible_text FROM nd GROUP BY page_id)"
        if name == "im":
            return f"""im_all AS (SELECT i.page_id, seq, {resolve('r', 'url')} AS src, alt, NOT hidden visible, {pos} AS position, w AS width, h AS height, NOT coalesce(w < 20 OR h < 20, false) meets, {y} y
  FROM (SELECT *, coalesce(nullif({attr('src')}, ''), {attr('data-src')}) r, nullif({attr('alt')}, '') alt,
   CAST({ext(attr('width'), '^[0-9]{1,6}')} AS INTEGER) w, CAST({ext(attr('height'), '^[0-9]{1,6}')} AS INTEGER) h FROM nd WHERE kind = 'open' AND tag = 'img') i JOIN (SELECT page_id, url FROM lp) u ON u.page_id = i.page_id),
im AS MATERIALIZED (SELECT * FROM im_all WHERE meets)"""
        raise KeyError(name)

    def sql(self, ctes: list[str], tail: str, extra: str = "") -> str:
        parts = [self.base()] + [self.cte(n) for n in ctes]
        if extra:
            parts.append(extra)
        return "WITH " + ",\n".join(parts) + "\n" + tail


LP = Ctx("lp", True)
LPM = Ctx("lp", False)
WEB = Ctx("web", False)
