"""Gate queries: scalar functions over addresses, prices, severities and captures of the given tables.

Their SQL states its own ranges, hosts and scales and computes every class from the rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gate import duck as D
from gate.duck import LP, s
from gate.q_more import _CTA, _CTA_SQL, _SUP
from gate.registry import detectors, register, snapshot
from pagelode.functions import hosts as H
from pagelode.functions import labels as L
from pagelode.functions import prices as P
from pagelode.functions import urls as U
from pagelode.operators import structured as S
from pagelode.plans import corpus as CO
from pagelode.plans import rules as R
from pagelode.plans.sections import Sections


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# =============================================================== prices


@register("c23_parse_amount", "SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '3' THEN floor(o_totalprice) WHEN '5' THEN CASE WHEN o_totalprice < 1000 OR o_totalprice >= 1000000 THEN floor(o_totalprice) END ELSE o_totalprice END AS amount FROM orders")
def _(spark, d):
    # The price of an order as each priority's clerk would write it; "€112.946" alone does not settle its separator.
    o, kind = read(spark, d, "orders"), F.substring("o_orderpriority", 1, 1)
    exact, whole = F.format_number("o_totalprice", 2), F.format_number(F.floor("o_totalprice"), 0)
    swapped = lambda x: F.translate(x, ",.", ".,")
    written = (F.when(kind == "1", F.concat(F.lit("$"), exact)).when(kind == "2", F.concat(F.lit("€"), swapped(exact))).when(kind == "3", F.concat(F.lit("$"), whole))
               .when(kind == "5", F.concat(F.lit("€"), swapped(whole))).otherwise(F.concat(swapped(F.replace(exact, F.lit(","), F.lit(""))), F.lit(" EUR"))))
    return o.select("o_orderkey", P.parse_amount(written).alias("amount"))


# =============================================================== addresses

# An event's address is the digest of what happened; the first or last 32 bits are its IPv4 address.
_MD5 = "md5(concat_ws('|', event_type, props, CAST(user_id AS {t})))"
_NETS = """nets AS (SELECT ((a * 256 + b) * 256 + c) * 256 AS low, ((a * 256 + b) * 256 + c) * 256 + (1::BIGINT << (32 - bits)) - 1 AS high FROM (VALUES
  (0::BIGINT, 0, 0, 8), (10, 0, 0, 8), (100, 64, 0, 10), (127, 0, 0, 8), (169, 254, 0, 16), (172, 16, 0, 12), (192, 0, 0, 24), (192, 0, 2, 24), (192, 88, 99, 24),
  (192, 168, 0, 16), (198, 18, 0, 15), (198, 51, 100, 24), (203, 0, 113, 24), (224, 0, 0, 4), (240, 0, 0, 4)) AS n(a, b, c, bits))"""
_IN_NETS = "EXISTS (SELECT 1 FROM nets WHERE {v} BETWEEN low AND high)"
_DOTTED = "CAST({v} // 16777216 AS VARCHAR) || '.' || CAST({v} // 65536 % 256 AS VARCHAR) || '.' || CAST({v} // 256 % 256 AS VARCHAR) || '.' || CAST({v} % 256 AS VARCHAR)"


def _number(hexed):
    return F.conv(hexed, 16, 10).cast("long")


@register("c30_c32_admission", f"""WITH {_NETS}, e AS (SELECT event_id, CAST('0x' || left({_MD5.format(t='VARCHAR')}, 8) AS BIGINT) AS v FROM events)
SELECT event_id, spelling, CASE WHEN {_IN_NETS.format(v='v')} THEN 'private_host' END AS code, {_DOTTED.format(v='v')} AS dotted FROM e, (VALUES ('dotted'), ('decimal'), ('hex'), ('short')) AS k(spelling)""")
def _(spark, d):
    e = read(spark, d, "events").select("event_id", _number(F.substring(F.expr(_MD5.format(t="STRING")), 1, 8)).alias("v"))
    part = lambda n: F.shiftright("v", n).bitwiseAND(255).cast("string")
    quad = F.concat_ws(".", part(24), part(16), part(8), part(0))
    short = F.concat_ws(".", part(24), F.col("v").bitwiseAND(0xFFFFFF).cast("string"))
    forms = {"dotted": quad, "decimal": F.col("v").cast("string"), "hex": F.concat(F.lit("0x"), F.lower(F.hex("v"))), "short": short}
    e = e.select("event_id", F.explode(F.array(*[F.struct(F.lit(k).alias("spelling"), x.alias("host")) for k, x in forms.items()])).alias("f")).select("event_id", "f.*")
    return e.select("event_id", "spelling", U.url_check(F.concat(F.lit("https://"), F.col("host"), F.lit("/")))["code"].alias("code"), U.ipv4_norm("host").alias("dotted"))


@register("c30_link_admission", LP.sql(["ln"], f"SELECT DISTINCT page_id, href, CASE WHEN {D.scheme('href')} NOT IN ('http', 'https') THEN 'unsupported_scheme' WHEN {D.host('href')} IS NULL THEN 'invalid_url' WHEN NOT contains({D.host('href')}, '.') THEN 'private_host' END AS code FROM ln WHERE href <> ''"))
def _(spark, d):
    links = snapshot(spark, d).links.filter("href <> ''").select("page_id", "href").distinct()
    return links.withColumn("code", U.url_check("href")["code"])


@register("c33_ipv6", f"""WITH {_NETS}, e AS (SELECT event_id, h, CAST('0x' || left(h, 4) AS BIGINT) AS g0, CAST('0x' || substr(h, 5, 4) AS BIGINT) AS g1, CAST('0x' || right(h, 8) AS BIGINT) AS v, CAST('0x' || substr(h, 5, 8) AS BIGINT) AS six
 FROM (SELECT event_id, {_MD5.format(t='VARCHAR')} AS h FROM events))
SELECT event_id, form, CASE WHEN form <> 'own' THEN {_IN_NETS.format(v='v')} WHEN g0 = 8194 THEN {_IN_NETS.format(v='six')}
 ELSE g0 BETWEEN 64512 AND 65023 OR g0 BETWEEN 65152 AND 65535 OR (g0 = 8193 AND g1 = 0) OR (g0 = 100 AND g1 = 65435) END AS private FROM e, (VALUES ('own'), ('mapped'), ('nat64')) AS k(form)""")
def _(spark, d):
    e = read(spark, d, "events").select("event_id", F.expr(_MD5.format(t="STRING")).alias("h"))
    group = lambda i: F.substring("h", 1 + 4 * i, 4)
    quad = F.concat_ws(".", *[_number(F.substring("h", i, 2)).cast("string") for i in (25, 27, 29, 31)])
    forms = {"own": F.concat_ws(":", *[group(i) for i in range(8)]), "mapped": F.concat(F.lit("::ffff:"), quad), "nat64": F.concat(F.lit("64:ff9b::"), group(6), F.lit(":"), group(7))}
    e = e.select("event_id", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), x.alias("address")) for k, x in forms.items()])).alias("f")).select("event_id", "f.*")
    return e.select("event_id", "form", U.is_private_ipv6("address").alias("private"))


# =============================================================== parties and outcomes

_under = lambda h, *names: "(" + " OR ".join(f"{h} = {s(n)} OR {h} LIKE {s('%.' + n)}" for n in names) + ")"
_GUARDS = _under("h", "challenges.cloudflare.com", "hcaptcha.com", "recaptcha.net", "gstatic.com", "google.com")
_METERS = _under("h", "google-analytics.com", "googletagmanager.com", "doubleclick.net", "facebook.com", "facebook.net", "tiktok.com", "linkedin.com", "hotjar.com", "hotjar.io", "clarity.ms", "posthog.com", "amplitude.com", "sentry.io")
_PARTY = f"CASE WHEN h IS NULL THEN 'unknown' WHEN {_GUARDS} THEN 'security_infrastructure' WHEN {_METERS} THEN 'analytics' WHEN {D.registrable('h')} = {D.registrable(D.host('url'))} THEN 'first_party' ELSE 'third_party' END"
_MAKER = f"CASE WHEN {_under('h', 'googletagmanager.com')} THEN 'Google Tag Manager' WHEN {_under('h', 'google-analytics.com')} THEN 'Google Analytics' WHEN {_under('h', 'facebook.com', 'facebook.net')} THEN 'Meta' END"


@register("c42_parties", LP.sql(["ln", "sc"], f"SELECT page_id, seq, coalesce(h, '') AS host, {_PARTY} AS party, {_MAKER} AS vendor FROM (SELECT page_id, seq, url, {D.host('href')} AS h FROM ln UNION ALL SELECT page_id, seq, url, host FROM sc WHERE coalesce(src, '') <> '')"))
def _(spark, d):
    doc = snapshot(spark, d)
    sources = doc.links.select("page_id", "seq", F.col("href").alias("src")).unionByName(doc.scripts.filter("src <> ''").select("page_id", "seq", "src"))
    at = sources.join(doc.base, "page_id").withColumn("src", U.resolve_url("src", "page_url"))
    return at.select("page_id", "seq", H.classify_party("src", "page_url").alias("p")).select("page_id", "seq", F.coalesce("p.host", F.lit("")).alias("host"), "p.party", "p.vendor")


# The answer to an event: its type gives the hundreds, its properties the rest; a signup was never answered.
_ANSWER = "CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 300 WHEN 'error' THEN 400 WHEN 'purchase' THEN 500 END + CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"


@register("c44_link_outcome", f"SELECT event_id, CASE WHEN st IS NULL THEN 'unreachable' WHEN st < 400 THEN 'ok' WHEN st IN (401, 403, 429, 999) THEN 'blocked' ELSE 'broken' END AS outcome, coalesce(st < 400 OR st IN (401, 403, 429, 999), false) AS ok FROM (SELECT event_id, {_ANSWER} AS st FROM events)")
def _(spark, d):
    e = read(spark, d, "events").select("event_id", F.expr(_ANSWER).alias("st"))
    return e.select("event_id", H.link_outcome("st").alias("o")).select("event_id", "o.outcome", "o.ok")


# How much a kind of event matters, and its value as the confidence.
_GRADE = "CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' WHEN 'click' THEN 'low' WHEN 'view' THEN 'informational' END"


@register("c45_severity", f"""WITH scale AS (SELECT * FROM (VALUES ('critical', 0, 'high', 'critical'), ('high', 1, 'medium', 'critical'), ('medium', 2, 'low', 'high'), ('low', 3, 'informational', 'medium'), ('informational', 4, 'informational', 'low')) AS t(sev, rank, down, up))
SELECT event_id, sev, rank, down, up, CASE WHEN value / 100 < 0.5 AND rank < 2 THEN down ELSE sev END AS tempered FROM (SELECT event_id, value, {_GRADE} AS sev FROM events) LEFT JOIN scale USING (sev)""")
def _(spark, d):
    e = read(spark, d, "events").withColumn("sev", F.expr(_GRADE))
    return e.select("event_id", "sev", L.sev_rank("sev").alias("rank"), L.downgrade("sev").alias("down"), L.upgrade("sev").alias("up"), L.temper("sev", F.col("value") / 100).alias("tempered"))


# =============================================================== embedded-form payloads and captures

# Every order as an embedded form that asks about its line items.
_ASKED = "CASE l_returnflag WHEN 'A' THEN '{a}' WHEN 'N' THEN '{n}' ELSE '{r}' END"


@register("c61_schema_fields", f"""SELECT DISTINCT l_orderkey AS page_id, 'q' || CAST(l_linenumber AS VARCHAR) || '_' || CAST(l_partkey AS VARCHAR) AS name, 'Keep part ' || CAST(l_partkey AS VARCHAR) || ' of line ' || CAST(l_linenumber AS VARCHAR) || '?' AS label,
 {_ASKED.format(a='text', n='radio', r='rating')} AS type, l_returnflag = 'N' AS required, CASE WHEN l_returnflag = 'N' THEN 'Part ' || CAST(l_partkey AS VARCHAR) || ',line' || CAST(l_linenumber AS VARCHAR) ELSE '' END AS options FROM lineitem""")
def _(spark, d):
    part, line = F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")
    asks = F.col("l_returnflag") == "N"
    choice = lambda label, ref: F.struct(label.alias("label"), ref.alias("ref"))
    field = F.struct(
        F.concat(F.lit("q"), line, F.lit("_"), part).alias("ref"), F.concat(F.lit("Keep part "), part, F.lit(" of line "), line, F.lit("?")).alias("title"),
        F.expr(_ASKED.format(a="short_text", n="multiple_choice", r="rating")).alias("type"), F.struct(asks.alias("required")).alias("validations"),
        F.struct(F.when(asks, F.array(choice(F.concat(F.lit("Part "), part), F.lit("a")), choice(F.lit(""), F.concat(F.lit("line"), line)))).alias("choices")).alias("properties"),
    )
    screen = F.array(F.struct(F.lit("welcome_screen").alias("type"), F.lit("Hi").alias("title")))
    forms = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.to_json(F.struct(screen.alias("screens"), F.struct(F.collect_list(field).alias("fields")).alias("group"))).alias("payload"))
    return S.schema_fields(forms.withColumn("seq", F.lit(0))).select("page_id", "name", "label", "type", "required", F.array_join("options", ",").alias("options"))


# Every document as a capture of the address of its source and language, in the order of ids, one a minute.
_ADDRESS = "concat('https://', coalesce(source, 'none'), '.example.com/', coalesce(lang, ''), '/')"


@register("k06_capture_diff", f"SELECT doc_id AS capture_id, key, prev IS NULL AS first, coalesce(prev <> h, false) AS changed FROM (SELECT *, lag(h) OVER (PARTITION BY key ORDER BY doc_id) AS prev FROM (SELECT doc_id, CASE WHEN coalesce(lang, '') = '' THEN a ELSE rtrim(a, '/') END AS key, sha256(coalesce(text, '')) AS h FROM (SELECT *, {_ADDRESS} AS a FROM documents)))")
def _(spark, d):
    t = read(spark, d, "documents").select(
        F.col("doc_id").alias("capture_id"), F.expr(_ADDRESS).alias("url"), F.timestamp_seconds(F.col("doc_id") * 60).alias("captured_at"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return CO.capture_diff(t).select("capture_id", "key", "first", "changed")


# =============================================================== what the browser logged

# Every event as a line of the browser's log on the landing page of its user's number: errors on the console, purchases as
# requests that failed, all else as answers. Its value and properties choose what was asked for.
_LOG = """SELECT user_id AS page_id, ts, CASE event_type WHEN 'error' THEN 'console' WHEN 'purchase' THEN 'requestfailed' ELSE 'response' END AS kind,
 CASE WHEN value < 10 THEN 'https://www.google-analytics.com/g' WHEN value < 20 THEN 'https://cdn.amplitude.com/a.js' WHEN value < 40 THEN 'https://widget.other.io/w.js' ELSE {origin} || CASE WHEN k < 20 THEN '/a1.png' WHEN k < 40 THEN '/logo.png' ELSE '/api/' || CAST(k AS {t}) END END AS url,
 CASE WHEN event_type IN ('view', 'click', 'signup') THEN 395 + k % 20 END AS status, CASE WHEN k < 50 THEN 'net::ERR_TIMED_OUT' ELSE 'net::ERR_ABORTED' END AS reason, 'TypeError: part ' || CAST(k AS {t}) || ' is undefined' AS text
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e JOIN {pages} p ON p.page_id = e.user_id"""
_LOG_SQL = "lg AS (" + _LOG.format(origin=D.origin("p.url"), t="VARCHAR", pages="lp") + ")"


def logged(spark, d):
    """Sections of the landing pages with the log of their browser."""
    det = detectors(spark, d)
    base = det.doc.base.select("page_id", F.concat(U.scheme("page_url"), F.lit("://"), U.host("page_url")).alias("origin"))
    events = spark.sql(_LOG.format(origin="p.origin", t="STRING", pages="{base}").replace("FROM events)", "FROM {events})"), base=base, events=read(spark, d, "events"))
    return Sections(det, events=events.withColumn("source", F.col("url")))


_PARTIES = f"""pt AS (SELECT page_id, what, CASE WHEN {_METERS} THEN 'analytics' WHEN {D.registrable('h')} = {D.registrable(D.host('page'))} THEN 'first_party' ELSE 'third_party' END AS party, count(*) AS n
 FROM (SELECT DISTINCT page_id, what, CASE WHEN what = 'failed' THEN lg_url || coalesce(CAST(status AS VARCHAR), '-') ELSE CAST(rn AS VARCHAR) END AS one, {D.host('lg_url')} AS h, page FROM
  (SELECT lg.page_id, lg.url AS lg_url, status, u.url AS page, CASE WHEN kind = 'console' THEN 'console' ELSE 'failed' END AS what, row_number() OVER () AS rn FROM lg JOIN lp u USING (page_id) WHERE lg.url NOT LIKE '%google-analytics.com%' AND (kind = 'console' OR status >= 400 OR (kind = 'requestfailed' AND reason NOT LIKE '%ERR_ABORTED%')))) GROUP BY ALL)"""


@register("f13_party_totals", LP.sql([], "SELECT page_id, " + ", ".join(
    f"sum(n) FILTER (WHERE what = '{w}') AS {a}, sum(n) FILTER (WHERE what = '{w}' AND party = 'first_party') AS {w}_first, string_agg(CAST(n AS VARCHAR) || ' ' || party, ', ' ORDER BY party) FILTER (WHERE what = '{w}') AS {w}_parties" for w, a in (("console", "console_errors"), ("failed", "failed_requests"))) + " FROM pt GROUP BY page_id", _LOG_SQL + ",\n" + _PARTIES))
def _(spark, d):
    t = R.technical_totals(logged(spark, d)).drop("redirects").filter("console_errors > 0 OR failed_requests > 0")
    none_as_null = lambda c: F.when(F.col(c) > 0, F.col(c)).alias(c)
    return t.select("page_id", "console_errors", none_as_null("console_first"), "console_parties", "failed_requests", none_as_null("failed_first"), "failed_parties")


@register("j08_broken_images", LP.sql(["im"], "SELECT page_id, count(DISTINCT src) AS broken FROM im WHERE src IN (SELECT url FROM lg WHERE lg.page_id = im.page_id AND kind <> 'console' AND (status IS NULL OR status >= 400)) AND coalesce(width, 0) >= 8 AND coalesce(height, 0) >= 8 AND NOT regexp_matches(src, '(?i)[.]svg') GROUP BY page_id", _LOG_SQL))
def _(spark, d):
    return R.broken_images(logged(spark, d)).filter("broken_image_lines IS NOT NULL").select("page_id", (F.size("broken_image_lines") - 1).alias("broken"))


# =============================================================== what probes of links said

# Every event as the answer to a probe of a destination on the landing page of its user's number; the earliest counts.
_PROBES = f"""SELECT user_id AS page_id, event_id AS seq, {_ANSWER} AS status,
 CASE WHEN value < 20 THEN 'https://calendly.com/acme/intro' WHEN value < 40 THEN 'https://buy.stripe.com/abc' WHEN value < 60 THEN 'https://acme.typeform.com/to/Ab12' ELSE 'https://status.other.org/x' END AS url FROM events"""
_JUDGED = "CASE WHEN p.page_id IS NULL THEN NULL WHEN status IS NULL THEN 'unreachable' WHEN status < 400 THEN 'ok' WHEN status IN (401, 403, 429, 999) THEN 'blocked' ELSE 'broken' END"


@register("f09_probed_ctas", LP.sql(["bt", "hd_all", "hd", "bl"], f"""SELECT DISTINCT page_id, url, CASE WHEN outcome IS NULL THEN 'not_checked' WHEN outcome IN ('ok', 'blocked') THEN 'ok' ELSE 'broken' END AS resolves, status, coalesce(outcome, 'none') AS outcome
 FROM (SELECT c.page_id, c.href AS url, status, {_JUDGED} AS outcome FROM calls c LEFT JOIN pb p ON p.page_id = c.page_id AND p.url = c.href WHERE c.href IN ('https://calendly.com/acme/intro', 'https://buy.stripe.com/abc', 'https://acme.typeform.com/to/Ab12'))""",
 f"{_CTA},{_SUP},\ncalls AS ({_CTA_SQL}),\npb AS (SELECT * FROM ({_PROBES}) QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY seq) = 1)"))
def _(spark, d):
    answers = spark.sql(_PROBES.replace("FROM events", "FROM {events}"), events=read(spark, d, "events"))
    probes = answers.withColumn("ok", H.link_outcome("status")["ok"])
    ctas = Sections(detectors(spark, d), probes=probes).ctas.filter(F.col("url").rlike("^https://(calendly[.]com/acme/intro|buy[.]stripe[.]com/abc|acme[.]typeform[.]com/to/Ab12)$"))
    judged = F.when(F.col("resolves") == "not_checked", "none").otherwise(F.col("outcome"))
    return ctas.select("page_id", "url", "resolves", "status", judged.alias("outcome")).distinct()
