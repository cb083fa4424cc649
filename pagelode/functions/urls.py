"""URL functions.

URLs are split with regular expressions: `parse_url` yields NULL for relative
references and for any URL holding a space. Scheme and host are lower-cased, the
path is kept as written (no percent-encoding), so keys compare by what the page says.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelode.functions.base import blank_to_null, c, chain, ext, has, let, sub, txt
from pagelode.functions.text import clip, strip

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
_HTTP = r"^[hH][tT][tT][pP][sS]?://"

# Second-level labels kept with the registrable domain.
SECOND_LEVEL = ["co", "com", "net", "org", "gov", "edu", "ac", "or", "ne", "gob", "govt", "asn"]
# Two-part suffixes of the second, coarser root-domain reading.
MULTI_PART = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "com.br", "co.za",
    "co.in", "co.jp", "com.mx", "com.sg",
]


def scheme(url: Column | str) -> Column:
    return F.lower(ext(url, _SCHEME, 1))


def authority(url: Column | str) -> Column:
    return ext(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#\\]*)", 1)


def host_port(url: Column | str) -> Column:
    """Host with an explicit non-default port, lower case, no credentials."""
    raw = F.lower(sub(authority(url), r"^.*@", ""))
    dflt = F.when(scheme(url) == "http", sub(raw, ":80$", "")).when(
        scheme(url) == "https", sub(raw, ":443$", "")
    ).otherwise(raw)
    return blank_to_null(sub(dflt, ":$", ""))


def host(url: Column | str) -> Column:
    """Host name of an absolute http(s)-like URL, NULL otherwise."""
    return blank_to_null(sub(host_port(url), r":[0-9]*$", ""))


def bare_host(url: Column | str) -> Column:
    """Host without a leading `www.`."""
    return sub(host(url), r"^www\.", "")


def path(url: Column | str) -> Column:
    p = F.regexp_extract(c(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def query(url: Column | str) -> Column:
    """Query with its `?`, empty when there is none."""
    return F.regexp_extract(c(url), r"^[^?#]*(\?[^#]*)", 1)


def fragment(url: Column | str) -> Column:
    return F.regexp_extract(c(url), r"#(.*)$", 1)


def origin(url: Column | str) -> Column:
    return F.concat(scheme(url), F.lit("://"), host_port(url))


def _fold_dots(p: Column) -> Column:
    """Resolve `.` and `..` segments of an absolute path."""
    segs = F.split(p, "/")
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        segs,
        empty,
        lambda acc, x: F.when(x == ".", acc)
        .when(
            x == "..",
            F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc),
        )
        .otherwise(F.concat(acc, F.array(x))),
    )
    tail = F.when(p.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.when(p.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(folded, "/"), tail)).otherwise(p)


def resolve_url(href: Column | str, base: Column | str) -> Column:
    """Absolute form of a reference found on `base`; NULL when it cannot be one."""

    def absolute(raw: Column) -> Column:
        good = host(raw).isNotNull() & ~host_port(raw).rlike(r"[\s<>^|%]")
        return (
            F.when(
                raw.rlike(_HTTP),
                F.when(good, F.concat(origin(raw), _fold_dots(path(raw)), query(raw), F.regexp_extract(raw, r"(#.*)$", 1))),
            )
            .when(raw.rlike(r"^[hH][tT][tT][pP][sS]?:"), F.lit(None).cast("string"))
            .otherwise(raw)
        )

    def relative(p: Column) -> Column:
        raw, org, where = p["raw"], p["org"], p["path"]
        rest = F.regexp_extract(raw, r"^[^?#]*(.*)$", 1)
        ref = F.regexp_extract(raw, r"^([^?#]*)", 1)
        full = F.concat(F.lit("http:"), raw)
        here = F.concat(org, where, p["query"])
        return (
            F.when(raw == "", here)
            .when(raw.startswith("#"), F.concat(here, raw))
            .when(raw.startswith("?"), F.concat(org, where, raw))
            .when(raw.startswith("//"), F.concat(
                F.regexp_extract(org, "^([^:]*):", 1), F.lit("://"), host_port(full), _fold_dots(path(full)), rest))
            .when(raw.startswith("/"), F.concat(org, _fold_dots(ref), rest))
            .otherwise(F.concat(org, _fold_dots(F.concat(F.regexp_extract(where, r"^(.*/)[^/]*$", 1), ref)), rest))
        )

    base = c(base)

    def by_kind(raw: Column) -> Column:
        parts = F.struct(
            raw.alias("raw"), origin(base).alias("org"), path(base).alias("path"), query(base).alias("query")
        )
        return F.when(raw.rlike(_SCHEME), absolute(raw)).otherwise(let(parts, relative))

    return let(strip(c(href)), by_kind)


def resolved_host(href: Column | str, base: Column | str) -> Column:
    """Host of a reference found on `base`. `host` reads its argument dozens of times, so it is resolved once."""
    return let(resolve_url(href, base), host)


def resolved_bare_host(href: Column | str, base: Column | str) -> Column:
    return sub(resolved_host(href, base), r"^www\.", "")


def is_http(url: Column | str) -> Column:
    return F.coalesce(c(url).rlike(r"^https?://"), F.lit(False))


def is_ip_literal(h: Column) -> Column:
    return h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | h.contains(":") | h.startswith("[")


def registrable_host(h: Column | str) -> Column:
    """`a.b.example.co.uk` -> `example.co.uk`; an IP literal is its own domain."""

    def tail(parts: Column) -> Column:
        keep = F.when(F.element_at(parts, -2).isin(SECOND_LEVEL), 3).otherwise(2)
        n = F.size(parts)
        return F.when(n <= 2, F.array_join(parts, ".")).otherwise(
            F.array_join(F.slice(parts, F.greatest(n - keep + 1, F.lit(1)), keep), ".")
        )

    def read(low: Column) -> Column:
        parts = F.filter(F.split(low, r"\."), lambda p: p != "")
        return F.when((low == "") | is_ip_literal(low), low).otherwise(let(parts, tail))

    return let(sub(F.lower(txt(c(h))), r"\.$", ""), read)


def root_domain(h: Column | str) -> Column:
    """Coarser grouping key; differs from `registrable_host` on purpose."""
    h = txt(c(h))
    parts = F.split(h, r"\.")
    n = F.size(parts)
    two = F.array_join(F.slice(parts, F.greatest(n - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(parts, F.greatest(n - 2, F.lit(1)), 3), ".")
    return F.when(is_ip_literal(h) | (n <= 2), h).when(two.isin(MULTI_PART), three).otherwise(two)


def same_site(a: Column | str, b: Column | str) -> Column:
    left = registrable_host(a)
    return (left != "") & (left == registrable_host(b))


def document_key(url: Column | str) -> Column:
    return F.concat(origin(url), path(url), query(url))


def same_document(url: Column | str, base: Column | str) -> Column:
    return F.coalesce(document_key(url) == document_key(base), F.lit(False))


def normalize_url(url: Column | str) -> Column:
    """No fragment, no trailing slash on a path; unparsable text comes back unchanged."""
    url = c(url)
    p = path(url)
    p = F.when(p != "/", sub(p, "/$", "")).otherwise(p)
    return F.coalesce(F.concat(origin(url), p, query(url)), url)


def is_hash_only_change(a: Column | str, b: Column | str) -> Column:
    a, b = c(a), c(b)
    return (a != "") & (b != "") & (a != b) & (normalize_url(a) == normalize_url(b))


def canonical_key(url: Column | str) -> Column:
    p = path(url)
    p = F.when(F.length(p) > 1, blank_to_null(sub(p, "/+$", ""))).otherwise(F.lit("/"))
    return F.concat(origin(url), F.coalesce(p, F.lit("")), query(url))


def contact_address(url: Column | str) -> Column:
    """Address of a mailto:/tel: link, decoded; a malformed escape is left as written."""
    body = strip(F.regexp_extract(c(url), r"^[a-zA-Z]+:([^?]*)", 1))
    # url_decode would turn '+' into a space, which a phone number must keep.
    decoded = F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B")))
    return blank_to_null(F.coalesce(decoded, body))


def redact_url(url: Column | str) -> Column:
    """Origin and path only; text that is no URL loses everything from `?` or `#` on."""
    return F.coalesce(F.concat(origin(url), path(url)), F.regexp_extract(c(url), r"^([^?#]*)", 1))


def trim_url(url: Column | str) -> Column:
    url = c(url)
    return F.when(F.length(url) > 300, F.concat(F.substring(url, 1, 300), F.lit("…"))).otherwise(url)


# Registrable hosts of social platforms (links section).
SOCIAL_HOSTS = {
    "facebook.com": "facebook", "fb.com": "facebook", "fb.me": "facebook", "instagram.com": "instagram",
    "instagr.am": "instagram", "linkedin.com": "linkedin", "lnkd.in": "linkedin", "x.com": "x",
    "twitter.com": "x", "youtube.com": "youtube", "youtu.be": "youtube", "tiktok.com": "tiktok",
    "threads.net": "threads", "threads.com": "threads", "whatsapp.com": "whatsapp", "wa.me": "whatsapp",
}
# Host patterns of social platforms (business identity).
SOCIAL_PATTERNS = [
    ("facebook", r"(^|\.)facebook\.com$|(^|\.)fb\.com$"),
    ("instagram", r"(^|\.)instagram\.com$"),
    ("linkedin", r"(^|\.)linkedin\.com$"),
    ("x", r"(^|\.)(twitter|x)\.com$"),
    ("youtube", r"(^|\.)youtube\.com$|(^|\.)youtu\.be$"),
    ("tiktok", r"(^|\.)tiktok\.com$"),
    ("pinterest", r"(^|\.)pinterest\.[a-z.]+$"),
    ("threads", r"(^|\.)threads\.net$"),
]


def social_platform(h: Column | str) -> Column:
    """Platform by registrable host, so m. and www. subdomains count."""
    reg = registrable_host(h)
    cases = [(reg == k, v) for k, v in SOCIAL_HOSTS.items()]
    return chain(cases + [(F.split(reg, r"\.")[0] == "pinterest", "pinterest")])


def social_profile(h: Column | str) -> Column:
    return chain([(has(h, p), name) for name, p in SOCIAL_PATTERNS])


# ------------------------------------------------------------- admission check

# Host names and suffixes that never name a public site.
PRIVATE_NAMES = [
    "localhost", "ip6-localhost", "ip6-loopback", "metadata", "metadata.google.internal", "metadata.goog",
    "instance-data",
]
PRIVATE_SUFFIXES = [
    ".localhost", ".local", ".internal", ".localdomain", ".home.arpa", ".lan", ".intranet", ".corp", ".home",
    ".private", ".consul", ".cluster.local", ".svc",
]
MAX_URL_LENGTH = 2048


def _octet_part(p: Column) -> Column:
    """One IPv4 part as a number: 0x hex, leading-zero octal, or decimal."""
    return (
        F.when(p == "0x", F.lit(0))
        .when(p.rlike("^0x[0-9a-f]{1,12}$"), F.conv(F.substring(p, 3, 12), 16, 10).try_cast("long"))
        .when(p.rlike("^0[0-7]{1,15}$"), F.conv(p, 8, 10).try_cast("long"))
        .when(p.rlike("^[0-9]{1,15}$"), p.try_cast("long"))
        .cast("long")
    )


def ipv4_value(h: Column | str) -> Column:
    """32-bit value of any IPv4 spelling a resolver accepts, NULL for other names."""
    weights = F.array(F.lit(16777216), F.lit(65536), F.lit(256))
    rooms = F.array(F.lit(4294967296), F.lit(16777216), F.lit(65536), F.lit(256))

    def read(nums: Column) -> Column:
        n = F.size(nums)
        last = F.element_at(nums, -1)
        lead = F.slice(nums, F.lit(1), F.greatest(n - 1, F.lit(0)))
        total = F.aggregate(
            F.transform(lead, lambda x, i: x * F.element_at(weights, i + 1)), last, lambda a, x: a + x
        )
        ok = (
            n.between(1, 4)
            & ~F.exists(nums, lambda x: x.isNull())
            & (last < F.get(rooms, n - 1))
            & ~F.exists(lead, lambda x: x > 255)
        )
        return F.when(ok, total)

    # Names with more parts, or without a digit, never are addresses.
    name = F.lower(c(h))
    parts = F.when(name.rlike(r"^[0-9a-fx]+(\.[0-9a-fx]+){0,3}$"), F.split(name, r"\."))
    return let(F.transform(parts, _octet_part), read)


def ipv4_norm(h: Column | str) -> Column:
    """Dotted quad of any IPv4 spelling, NULL for other names."""
    return let(
        ipv4_value(h),
        lambda v: F.concat(
            F.shiftright(v, 24).cast("string"), F.lit("."), F.shiftright(v, 16).bitwiseAND(255).cast("string"),
            F.lit("."), F.shiftright(v, 8).bitwiseAND(255).cast("string"), F.lit("."),
            v.bitwiseAND(255).cast("string"),
        ),
    )


# Reserved IPv4 ranges as (first address, prefix length).
RESERVED_IPV4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.88.99.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
]


def _ranges() -> list[tuple[int, int]]:
    out = []
    for first, bits in RESERVED_IPV4:
        a, b, d, e = (int(x) for x in first.split("."))
        low = (a << 24) + (b << 16) + (d << 8) + e
        out.append((low, low + (1 << (32 - bits)) - 1))
    return out


def is_private_ipv4(value: Column) -> Column:
    def inside(v: Column) -> Column:
        cond = F.lit(False)
        for low, high in _ranges():
            cond = cond | v.between(low, high)
        return cond

    return let(value, inside)


def ipv6_groups(h: Column | str) -> Column:
    """Eight 16-bit groups of an IPv6 literal (zone dropped, IPv4 tail folded), else NULL."""
    none = F.array().cast("array<string>")
    groups_of = lambda x: F.when(x == "", none).otherwise(F.split(x, ":"))

    def fold_v4(text: Column) -> Column:
        tail = F.regexp_extract(text, r":([^:]*\.[^:]*)$", 1)
        hexed = lambda v: F.concat(
            F.regexp_extract(text, r"^(.*:)[^:]*$", 1),
            F.lower(F.hex(F.shiftright(v, 16))), F.lit(":"), F.lower(F.hex(v.bitwiseAND(65535))),
        )
        return F.when(text.rlike(r":[^:]*\.[^:]*$"), let(ipv4_value(tail), hexed)).otherwise(text)

    def expand(halves: Column) -> Column:
        left, right = groups_of(halves[0]), groups_of(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        missing = 8 - F.size(left) - F.size(right)
        return F.when(F.size(halves) == 1, F.when(F.size(left) == 8, left)).when(
            (F.size(halves) == 2) & (missing >= 1),
            F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right),
        )

    def numbers(groups: Column) -> Column:
        ok = ~F.exists(groups, lambda g: ~g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(ok, F.transform(groups, lambda g: F.conv(g, 16, 10).try_cast("long")))

    text = let(sub(c(h), "%.*$", ""), fold_v4)
    return let(let(F.split(text, "::"), expand), numbers)


def is_private_ipv6(h: Column | str) -> Column:
    """Unparsable, unspecified, loopback, local, multicast, or carrying a private IPv4."""

    def judge(g: Column) -> Column:
        at = lambda i: F.get(g, F.lit(i))
        zero = lambda a, b: F.forall(F.slice(g, a + 1, b - a), lambda x: x == 0)
        pair = lambda a, b: at(a) * 65536 + at(b)
        split = (
            (F.shiftright(at(3), 8) * 16777216)
            + (at(3).bitwiseAND(255) * 65536)
            + (at(4).bitwiseAND(255) * 256)
            + F.shiftright(at(5), 8)
        )
        mapped = zero(0, 5) & at(5).isin(0, 65535)
        nat64 = (at(0) == 0x64) & (at(1) == 0xFF9B)
        carried = (
            F.when(mapped | (nat64 & zero(2, 6)), pair(6, 7))
            .when(nat64 & (at(2) == 1), split)
            .when(at(0) == 0x2002, pair(1, 2))
        )
        return (
            F.when(g.isNull() | (zero(0, 7) & at(7).isin(0, 1)), F.lit(True))
            .when(carried.isNotNull(), is_private_ipv4(carried))
            .otherwise(
                nat64
                | ((at(0) == 0x2001) & (at(1) == 0))
                | ((at(0) == 0x100) & zero(1, 4))
                | (at(0).bitwiseAND(0xFE00) == 0xFC00)
                | at(0).bitwiseAND(0xFFC0).isin(0xFE80, 0xFEC0)
                | (at(0).bitwiseAND(0xFF00) == 0xFF00)
            )
        )

    return let(ipv6_groups(h), judge)


def is_private_host(h: Column | str) -> Column:
    def judge(bare: Column) -> Column:
        suffix = F.lit(False)
        for s in PRIVATE_SUFFIXES:
            suffix = suffix | bare.endswith(s)
        return (
            F.when((bare == "") | bare.contains("..") | bare.isin(PRIVATE_NAMES) | suffix, F.lit(True))
            .when(bare.contains(":"), is_private_ipv6(bare))
            .otherwise(let(ipv4_value(bare), lambda v: F.coalesce(is_private_ipv4(v), ~bare.contains("."))))
        )

    low = sub(F.lower(strip(txt(c(h)))), r"\.+$", "")
    return let(F.regexp_replace(low, r"^\[(.*)\]$", "$1"), judge)


def url_check(url: Column | str, allow_private: bool = False) -> Column:
    """Admission of a target URL: struct(ok, code), code NULL when admitted."""

    def named(raw: Column, auth: Column, name: Column) -> Column:
        inner = F.regexp_replace(name, r"^\[(.*)\]$", "$1")
        # A host whose last label is numeric must read as an IPv4 address.
        bad = (
            F.when(name.startswith("["), ipv6_groups(inner).isNull())
            .when(name.rlike(r"(^|\.)(\d+|0x[0-9a-f]*)\.?$"), ipv4_value(sub(name, r"\.$", "")).isNull())
            .otherwise((name == "") | name.rlike(r"[\s<>^|%\\]|:"))
        )
        cases = [
            (F.coalesce(bad, F.lit(True)), "invalid_url"),
            (auth.rlike("^.+@"), "credentials_not_allowed"),
        ]
        if not allow_private:
            cases.append((is_private_host(name), "private_host"))
        return chain(cases)

    def code_of(raw: Column) -> Column:
        auth = txt(authority(raw))
        name = sub(sub(F.lower(auth), "^.*@", ""), r":[0-9]*$", "")
        early = chain([
            (raw == "", "invalid_url"),
            (F.length(raw) > MAX_URL_LENGTH, "url_too_long"),
            (scheme(raw).isNull(), "invalid_url"),
            (~scheme(raw).isin("http", "https"), "unsupported_scheme"),
        ])
        return F.coalesce(early, let(F.struct(auth.alias("a"), name.alias("n")), lambda p: named(raw, p["a"], p["n"])))

    return let(let(strip(txt(c(url))), code_of), lambda k: F.struct(k.isNull().alias("ok"), k.alias("code")))


# ------------------------------------------------------------------ identities

def _slug(part: Column) -> Column:
    return F.substring(sub(sub(F.lower(part), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)


def funnel_id(url: Column | str) -> Column:
    """Host with dashes plus the first two slugged path parts; query ignored."""
    url = c(url)
    h = F.replace(bare_host(url), F.lit("."), F.lit("-"))
    parts = F.slice(F.filter(F.split(path(url), "/"), lambda p: p != ""), 1, 2)
    slugs = F.filter(F.transform(parts, lambda p: _slug(F.coalesce(F.try_url_decode(p), p))), lambda p: p != "")
    name = F.element_at(F.filter(F.split(url, r"[/\\]"), lambda p: p != ""), -1)
    local = F.concat(F.lit("local_"), F.coalesce(blank_to_null(_slug(sub(name, r"\.[^.]+$", ""))), F.lit("page")))
    return (
        F.when(url.rlike("^file:"), local)
        .when(h.isNull(), F.lit("funnel"))
        .when(F.size(slugs) > 0, F.concat(h, F.lit("_"), F.array_join(slugs, "_")))
        .otherwise(h)
    )


def crawl_id(url: Column | str, ts: Column | str) -> Column:
    return F.concat(funnel_id(url), F.lit("_"), F.date_format(c(ts), "yyyy-MM-dd_HHmm"))


def quote_url(url: Column, n: int = 100) -> Column:
    return clip(url, n)


