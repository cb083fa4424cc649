"""Hero, identity, technical facts and totals of a page as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gate import duck as D
from gate.duck import LP, s
from gate.registry import register, sections, snapshot
from pagelode.functions import claims as C
from pagelode.functions import labels as L
from pagelode.functions import text as T
from pagelode.functions import urls as U
from pagelode.operators import eventlog as EV
from pagelode.plans import embedded as EM
from pagelode.plans import overview as O
from pagelode.plans import rules as R

_SCREEN = """hh AS (SELECT page_id, seq, level, trim("text", ' ') t, visible, y FROM hd WHERE y < 900 AND trim("text", ' ') <> ''),
bb AS (SELECT page_id, seq, trim("text", ' ') t, visible, y FROM bl WHERE y < 900 AND trim("text", ' ') <> '')"""
_HERO = _SCREEN + """,
top AS (SELECT * FROM hh QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN visible AND level = 1 THEN 0 WHEN visible THEN 1 ELSE 2 END, seq) = 1),
nxt AS (SELECT hh.page_id, hh.t FROM hh JOIN top ON top.page_id = hh.page_id WHERE hh.seq <> top.seq AND hh.t <> top.t AND hh.y >= top.y
  QUALIFY row_number() OVER (PARTITION BY hh.page_id ORDER BY NOT hh.visible, hh.seq) = 1),
fb AS (SELECT bb.page_id, bb.t FROM bb LEFT JOIN top ON top.page_id = bb.page_id WHERE bb.visible AND length(bb.t) >= 21 AND bb.t IS DISTINCT FROM top.t
  QUALIFY row_number() OVER (PARTITION BY bb.page_id ORDER BY bb.seq) = 1),
tx2 AS (SELECT lp.page_id, top.t headline, coalesce(nxt.t, fb.t) subheadline FROM lp LEFT JOIN top ON top.page_id = lp.page_id LEFT JOIN nxt ON nxt.page_id = lp.page_id LEFT JOIN fb ON fb.page_id = lp.page_id)"""


@register("h13_hero_texts", LP.sql(["hd_all", "hd", "bl"], """SELECT page_id, headline, subheadline, (SELECT count(DISTINCT t) FROM bb WHERE bb.page_id = x.page_id AND t IS DISTINCT FROM headline AND t IS DISTINCT FROM subheadline) AS supporting
 FROM tx2 x""", _HERO))
def _(spark, d):
    return O.hero_texts(sections(spark, d)).select("page_id", "headline", "subheadline", F.size("supporting_copy").cast("long").alias("supporting"))


_NAMES = f"coalesce(regexp_matches(headline, {s(C.OUTCOME_VERB)}), false)"


@register("e36_value_proposition", LP.sql(["hd_all", "hd", "bl"], f"SELECT page_id, headline IS NOT NULL AS detected, CASE WHEN headline IS NOT NULL THEN {_NAMES} END AS names_outcome FROM tx2", _HERO))
def _(spark, d):
    t = O.hero(sections(spark, d))
    return t.select("page_id", (F.col("status") == "detected").alias("detected"), F.when(F.col("headline").isNotNull(), F.col("headline").rlike(C.OUTCOME_VERB)).alias("names_outcome"))


@register("i03_hero")
def _(spark, d):
    return O.hero(sections(spark, d))


_TRUST = " UNION ALL ".join(
    f"SELECT page_id, {s(kind)} AS kind, lower({D.clip(D.collapse('t'), 160, 'dots')}) AS text FROM (SELECT * FROM hh UNION ALL SELECT page_id, seq, 0, t, visible, y FROM bb) WHERE visible AND {D.has('t', p)}"
    for kind, p in (("rating", C.HERO_RATING), ("media_mention", C.HERO_MENTION), ("guarantee", C.HERO_GUARANTEE), ("security", C.HERO_SECURITY)))


@register("h14_trust_wording", LP.sql(["hd_all", "hd", "bl"], f"SELECT DISTINCT page_id, kind, text FROM ({_TRUST})", _SCREEN))
def _(spark, d):
    t = O.trust_elements(sections(spark, d)).filter(F.col("kind").isin("rating", "media_mention", "guarantee", "security"))
    return t.select("page_id", "kind", F.lower("text").alias("text"))


@register("h14_trust")
def _(spark, d):
    return O.trust_elements(sections(spark, d))


_LINK = "trim(coalesce(href, ''), ' ')"
_SOCIAL = "CASE " + " ".join(f"WHEN regexp_matches({D.host('href')}, {s(p)}) THEN {s(n)}" for n, p in U.SOCIAL_PATTERNS) + " END"


@register("g19_contacts", LP.sql(["ln", "vt"], f"""SELECT DISTINCT page_id, 'email' AS kind, lower(url_decode(regexp_extract(href, '^[a-zA-Z]+:([^?]*)', 1))) AS value FROM ln WHERE regexp_matches(coalesce(href, ''), '(?i)^mailto:') AND contains(url_decode(href), '@')
UNION SELECT page_id, 'email', lower(unnest(regexp_extract_all(visible_text, {s(C.EMAIL)}))) FROM vt
UNION SELECT page_id, 'social', href FROM ln WHERE NOT regexp_matches(coalesce(href, ''), '(?i)^(mailto|tel):') AND {_SOCIAL} IS NOT NULL"""))
def _(spark, d):
    return O.contacts(sections(spark, d)).filter("kind IN ('email', 'social')").select("page_id", "kind", "value")


@register("i01_identity")
def _(spark, d):
    return O.identity(sections(spark, d))


@register("g03_third_party_scripts", LP.sql(["sc"], f"SELECT page_id, lower(host) AS host, count(*) AS count FROM sc WHERE coalesce(host, '') <> '' AND {D.registrable('lower(host)')} <> {D.registrable(D.host('url'))} GROUP BY ALL"))
def _(spark, d):
    return O.third_party_scripts(sections(spark, d))


@register("g18_technical", LP.sql(["sc"], f"""SELECT lp.page_id, starts_with(lower(url), 'https:') AS https, coalesce(n, 0) AS script_count, v AS viewport_meta FROM lp
 LEFT JOIN (SELECT page_id, count(*) n FROM sc GROUP BY 1) c ON c.page_id = lp.page_id
 LEFT JOIN (SELECT page_id, coalesce(nullif(trim({D.attr('content')}, ' '), ''), 'present') v FROM nd WHERE kind = 'open' AND tag = 'meta' AND {D.attr('name')} = 'viewport' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY seq) = 1) m ON m.page_id = lp.page_id"""))
def _(spark, d):
    return O.technical(sections(spark, d)).select("page_id", "https", "script_count", "viewport_meta")


@register("i21_technical")
def _(spark, d):
    return O.technical(sections(spark, d))


@register("g20_tracking_statements")
def _(spark, d):
    return O.tracking_statements(sections(spark, d))


@register("i22_summary")
def _(spark, d):
    sec = sections(spark, d)
    return O.summary(sec, R.issues(sec))


# ---------------------------------------------------------------- wording of blocks and links


@register("d02_headings", LP.sql(["hd_all", "hd"], "SELECT page_id, seq, level, \"text\", visible, length(\"text\") AS length, coalesce(position = 'above_fold', false) AS above_fold FROM hd"))
def _(spark, d):
    return EM.headings_section(snapshot(spark, d).headings)


@register("d01_top_headings", LP.sql(["hd_all", "hd"], "SELECT page_id, count(*) FILTER (WHERE level IN (1, 2)) AS top, count(*) FILTER (WHERE level IN (3, 4, 5, 6)) AS sub FROM hd GROUP BY page_id"))
def _(spark, d):
    top, sub = EM.split_headings(snapshot(spark, d).headings)
    n = lambda df, name: df.groupBy("page_id").agg(F.count(F.lit(1)).alias(name))
    return n(top, "top").join(n(sub, "sub"), "page_id", "full").fillna(0)


@register("h15_placed_proof")
def _(spark, d):
    return EM.placed_proof(sections(spark, d))


_CHALLENGE = "just a moment|attention required|checking your browser|verify you are human|cf-challenge"
_DENIED = "access denied|403 forbidden|request blocked"


@register("c49_blockers", f"SELECT doc_id, CASE WHEN regexp_matches(lower(text), {s(_CHALLENGE)}) THEN 'anti-bot challenge page detected' WHEN regexp_matches(lower(text), {s(_DENIED)}) THEN 'access denied page detected' END AS blocker FROM documents")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", L.blocker(F.lit(None).cast("string"), F.col("text")).alias("blocker"))


@register("c54_list_items", LP.sql(["bl"], f"""SELECT page_id, seq, length(t) BETWEEN 8 AND 120 AND NOT regexp_matches(t, '[.!?]\\s+\\S') AND {D.word_count('t')} <= 20 AS item FROM (SELECT page_id, seq, {D.collapse('"text"')} t FROM bl)"""))
def _(spark, d):
    return snapshot(spark, d).blocks.select("page_id", "seq", T.looks_like_item("text").alias("item"))


_PLATFORM = "calendly[.]com|cal[.]com|tidycal[.]com|acuityscheduling[.]com|kajabi[.]com|clickfunnels[.]com|kartra[.]com|thrivecart[.]com|samcart[.]com|stripe[.]com|checkout[.]com|hubspot[.]com|typeform[.]com|convertkit[.]com|kit[.]com|activehosted[.]com|gohighlevel[.]com|leadpages[.]co|webinarjam[.]com|stealthseminar[.]com|demio[.]com|zoom[.]us"


@register("c65_next_hops", LP.sql(["ln"], f"""SELECT page_id, seq, coalesce(regexp_replace(h, '^www[.]', '') = regexp_replace({D.host('url')}, '^www[.]', '') OR regexp_matches(h, {s('(' + _PLATFORM + ')$')}), false) AS next_hop,
 regexp_matches("text", '(?i)\\b(apply|book|schedule|register|get access|watch|join|buy|start|get started|save (my )?spot|reserve|claim|enroll|continue|yes|submit|download|unlock)\\b') AS funnel_label
 FROM (SELECT *, {D.host('href')} h FROM ln)"""))
def _(spark, d):
    doc = snapshot(spark, d)
    t = doc.links.join(doc.base, "page_id")
    return t.select("page_id", "seq", L.is_next_hop("href", F.regexp_replace(U.host("page_url"), r"^www[.]", "")).alias("next_hop"), L.looks_funnel_cta("text").alias("funnel_label"))


@register("c37_claimed_results", LP.sql(["bl"], f"SELECT page_id, seq, trim({D.ext('\"text\"', C.CLAIMED_RESULT, 1)}, ' ') AS result FROM bl WHERE regexp_matches(\"text\", {s(C.CLAIMED_RESULT)})"))
def _(spark, d):
    return snapshot(spark, d).blocks.withColumn("result", C.claimed_result("text")).filter("result IS NOT NULL").select("page_id", "seq", "result")


@register("n03_error_counts", "SELECT user_id AS page_id, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS minute, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY ALL")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    kind = F.when(F.col("event_id") % 3 == 0, "pageerror").otherwise("response")
    log = e.select(F.col("user_id").alias("page_id"), "ts", kind.alias("kind"), F.col("event_type").alias("text"), F.lit(None).cast("string").alias("source"))
    return EV.errors(log).groupBy("page_id", F.date_trunc("minute", "ts").alias("minute")).agg(F.count(F.lit(1)).alias("n"))
