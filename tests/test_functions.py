"""Column functions on inline rows."""

from pyspark.sql import functions as F

from pagelode.functions import base as B
from pagelode.functions import claims as C
from pagelode.functions import hosts as H
from pagelode.functions import labels as L
from pagelode.functions import prices as P
from pagelode.functions import text as T
from pagelode.functions import urls as U


def test_url_admission(one):
    cases = {
        "http://127.0.0.1/": "private_host", "http://0177.0.0.1/": "private_host", "http://2130706433/": "private_host", "http://0x7f000001/": "private_host",
        "http://127.1/": "private_host", "http://10.1.2.3/": "private_host", "http://172.20.0.1/": "private_host", "http://192.168.1.1/": "private_host",
        "http://169.254.169.254/latest": "private_host", "http://100.64.0.1/": "private_host", "http://[::1]/": "private_host", "http://[::ffff:10.0.0.1]/": "private_host",
        "http://[fd00::1]/": "private_host", "http://[fe80::1]/": "private_host", "http://[64:ff9b::7f00:1]/": "private_host", "http://[2002:7f00:1::]/": "private_host",
        "http://localhost:3000/": "private_host", "http://localhost../": "private_host", "http://intranet/": "private_host", "http://db.internal/": "private_host",
        "http://printer.lan": "private_host", "http://metadata.google.internal/": "private_host", "https://example.com/": None, "https://8.8.8.8/": None,
        "http://[2606:4700::1111]/": None, "https://sub.shop.example.co.uk:8443/a?b=1#c": None, "ftp://example.com/": "unsupported_scheme", "javascript:alert(1)": "unsupported_scheme",
        "https://user:pw@example.com/": "credentials_not_allowed", "": "invalid_url", "nope": "invalid_url", "https://": "invalid_url", "https://example.com/" + "a" * 2048: "url_too_long",
    }
    got = one(list(cases), "u string", U.url_check("u")["code"])
    assert dict(zip(cases, got)) == cases


def test_resolve(one):
    base = "https://Www.Example.com/a/b.html?q=1#f"
    cases = {
        "/x/../y?z": "https://www.example.com/y?z", "c/./d": "https://www.example.com/a/c/d", "../up": "https://www.example.com/up", "?k": "https://www.example.com/a/b.html?k",
        "#t": "https://www.example.com/a/b.html?q=1#t", "//cdn.example.org/x.js": "https://cdn.example.org/x.js", "HTTP://Other.ORG": "http://other.org/", "mailto:a@b.c": "mailto:a@b.c",
        "http://bad host/": None, "../../../etc/./x/": "https://www.example.com/etc/x/",
    }
    got = one([(k, base) for k in cases], "h string, b string", U.resolve_url("h", "b"))
    assert dict(zip(cases, got)) == cases


def test_domains(one):
    hosts = ["a.b.example.co.uk", "example.com", "x.example.com.", "10.0.0.1", "shop.gov.uk", "a.b.org.uk"]
    assert one(hosts, "h string", U.registrable_host("h")) == ["example.co.uk", "example.com", "example.com", "10.0.0.1", "shop.gov.uk", "b.org.uk"]
    assert one(["a.b.example.co.in", "x.example.net"], "h string", U.root_domain("h")) == ["example.co.in", "example.net"]
    assert one(["https://www.acme.com/free-training/step%201/x?utm=1"], "u string", U.funnel_id("u")) == ["www-acme-com_free-training_step-1".replace("www-", "")]
    assert one([("https://a.com/p#x", "https://a.com/p#y"), ("https://a.com/p", "https://a.com/q")], "a string, b string", U.is_hash_only_change("a", "b")) == [True, False]


def test_field_purpose(one):
    rows = [
        ("email", None, "text", None, None, None), ("email_address", None, "text", None, None, None), ("x", None, "text", None, None, "email"), ("first_name", None, "text", None, None, None),
        ("lname", None, "text", None, None, None), ("p", None, "tel", None, None, None), ("n", None, "text", "Your Name", None, None), ("ok", None, "checkbox", "I agree to terms", None, None),
        ("pw", None, "password", None, None, None), ("c", None, "text", None, None, "cc-number"), ("rev", None, "text", "Monthly revenue?", None, None),
    ]
    got = one(rows, "name string, id string, type string, label string, placeholder string, auto string", L.field_purpose("name", "id", "type", "label", "placeholder", "auto"))
    assert got == ["email", "email", "email", "first_name", "last_name", "phone", "full_name", "consent", "password", "payment", "other"]


def test_severity(one):
    sev = ["critical", "high", "medium", "low", "informational"]
    assert one(sev, "s string", L.downgrade("s")) == sev[1:] + ["informational"]
    assert one(sev, "s string", L.upgrade("s")) == ["critical"] + sev[:-1]
    assert one([("high", 0.4), ("high", 0.5), ("medium", 0.1)], "s string, c double", L.temper("s", "c")) == ["medium", "high", "medium"]
    assert one(["application funnel", "page"], "s string", T.with_article("s")) == ["an application funnel", "a page"]


def test_party(one):
    rows = [
        ("https://cdn.shop.co.uk/a.js", "https://www.shop.co.uk/", "x"), ("https://challenges.cloudflare.com/t", "https://shop.com", "x"),
        ("https://www.google-analytics.com/g", "https://shop.com", "x"), (None, "https://shop.com", "third-party cookie will be blocked"), ("https://widget.io/w.js", "https://shop.com", "x"),
    ]
    got = one(rows, "s string, p string, t string", H.classify_party("s", "p", "t")["party"])
    assert got == ["first_party", "security_infrastructure", "analytics", "browser", "third_party"]


def test_amounts(one):
    cases = {"$1,234.56": 1234.56, "1.234,56 EUR": 1234.56, "$1,500": 1500.0, "€1.500": None, "0.500": 0.5, "$97": 97.0, "1.234.567": 1234567.0, "12,5": 12.5, "1,23,456": None, "$": None}
    assert one(list(cases), "a string", P.parse_amount("a")) == list(cases.values())
    text = "Great course. Only $97 per month today! Annual plans below."
    assert one([(text, "$97")], "t string, a string", P.near_price("t", "a")) == [" Only $97 per month today"]


def test_sentences_and_guarantees(one):
    rows = ["30-day money-back guarantee.", "No refunds are offered.", "We do not offer refunds.", "All sales are final, no refunds.", "Refund policy", "See our refund policy", "Our refund policy is a 14-day guarantee", "No credit card required", "Refunds are not available"]
    assert one(rows, "s string", C.guarantee("s")) == ["money_back", None, None, None, None, None, "money_back", "free_trial", None]
    assert one(["Hi there. Then more! next | Last"], "s string", T.sentences("s")) == [["Hi there.", "Then more! next", "Last"]]


def test_people_and_dates(one):
    rows = ["— Jane Doe, CEO of Acme Labs", "John Smith | Coach", "Ann Lee, Acme Group", "not a name at all", "Maria, likes pies"]
    got = one(rows, "s string", C.parse_attribution("s"))
    assert [tuple(g) if g else None for g in got] == [("Jane Doe", "CEO", "Acme Labs"), ("John Smith", "Coach", None), ("Ann Lee", None, "Acme Group"), None, None]
    assert one(["March 3rd, 2026", "15 sept", "June 40", "3/4/2026"], "s string", C.parse_month_date("s")["date"]) == ["3-3", "9-15", None, None]
    assert one(["★★★★★ great", "4.5/5", "3/5/2024", "4 out of 5", "9 stars"], "s string", C.rating_in("s")) == [5.0, 4.5, None, 4.0, None]


def test_phrases(one):
    assert one(["A free strategy call with us", "Community", "Coaching program inside", "our live workshop"], "s string", C.qualified_noun("s")) == ["call", None, "coaching program", "workshop"]
    assert one(["built for busy agency owners today", "for free"], "s string", C.audience("s")) == ["busy agency owners", None]
    assert one(["Copyright © 2025 HackFit LLC. All rights reserved", "© 2020-2024, Blue Sky Inc"], "s string", C.clean_brand(C.copyright_holder("s"))) == ["HackFit LLC", "Blue Sky Inc"]
    assert one(["i have already tried it all", "i have already tried it and lost 10 kg"], "s string", C.is_problem_statement("s")) == [True, False]
    assert one([" in Forbes, then CNN", " on our page"], "s string", C.outlet_after("s")) == ["Forbes", None]


def test_entities(one):
    assert one(["a&#39;b &amp;copy; &copy; &#x1F600;&nbsp;x"], "s string", T.decode_entities("s")) == ["a'b &copy; © 😀 x"]


def test_sql_functions(spark):
    from pagelode.functions.sql import register_sql

    register_sql(spark)
    row = spark.sql("SELECT pl_collapse('  a   b ') a, pl_registrable_host('x.y.example.co.uk') b, pl_count_char('a!b!', '!') c").first()
    assert tuple(row) == ("a b", "example.co.uk", 2)


def test_null_inputs(spark):
    df = spark.range(1).select(F.lit(None).cast("string").alias("s"))
    row = df.select(T.collapse("s"), U.host("s"), U.url_check("s")["code"], P.parse_amount("s"), C.rating_in("s"), H.embed_provider("s")).first()
    assert list(row) == ["", None, "invalid_url", None, None, None]


def test_white_space_classes_split_all_characters(one):
    """Both classes give what a browser calls white space, and put what most characters are first."""
    spaces = [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    others = [0, 8, 14, 31, 33, 97, 0x9F, 0xA1, 0xE9, 0x167F, 0x1681, 0x1FFF, 0x200B, 0x2027, 0x202A, 0x2030, 0x2060, 0x2FFF, 0x3001, 0xFEFE, 0xFF00, 0x1F600, 0x10FFFF]
    chars = [chr(n) for n in spaces + others] + ["\ufeff"]
    got = one(chars, "c string", F.struct(F.col("c").rlike(rf"\A{B.WS}\z"), F.col("c").rlike(rf"\A{B.NOT_WS}\z")))
    assert [tuple(g) for g in got] == [(True, False)] * len(spaces) + [(False, True)] * len(others) + [(True, False)]
    assert B.NOT_WS.startswith("[!-") and "&&" in B.WS


def test_word_edges_are_simple_where_a_word_character_is_sure(one):
    edge = B._EDGE
    cases = {
        r"(?i)\b(foo|bars?)\b": r"(?i)(?<!\w)(foo|bars?)(?!\w)", r"\b(?:only\s+)?\d{1,4}\b": r"(?<!\w)(?:only\s+)?\d{1,4}(?!\w)",
        r"^q$|\bsearch\b": r"^q$|(?<!\w)search(?!\w)", r"\b[.]x\b": edge + r"[.]x(?!\w)", r"\b(a|)b": edge + "(a|)b", r"\bx(?=\d)\b": r"(?<!\w)x(?=\d)" + edge,
        r"\d\s?%\b": r"\d\s?%" + edge, r"\b[A-z]": edge + "[A-z]", r"a?\b": "a?" + edge, r"(?:\bfoo|bar\b)\b": r"(?:(?<!\w)foo|bar(?!\w))" + edge, "no edge": "no edge",
    }
    assert {p: B.rx(p) for p in cases} == cases
    texts = ["foo", "foobar", "a foo.", "éfoo", "fooé", "_foo", "bars 12", "only 3", "only3", "x5", "search", "research", "[.x", "ab", "b", "50 %", "50%a", "", "bar-foo"]
    for p in cases:
        found = one(texts, "t string", F.struct(F.regexp_extract_all("t", F.lit(B.rx(p)), F.lit(0)), F.regexp_extract_all("t", F.lit(p.replace(r"\b", edge)), F.lit(0))))
        assert all(a == b for a, b in found), p
