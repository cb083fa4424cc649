"""Landing pages derived from the given tables, in SQL both engines read.

The `pages` table has no forms, media, prices or metadata, so most detectors would stay
idle on it. These pages wrap every document's whole text in landing-page markup whose
parts switch on and off with `doc_id`; there is one page per document.
"""

from __future__ import annotations

from pyspark.sql import functions as F

_T = "replace(replace(text, '&', '&amp;'), '<', '&lt;')"


def _on(cond: str, html: str) -> str:
    return f"CASE WHEN {cond} THEN {html} ELSE '' END"


def _lit(s: str) -> str:
    assert "'" not in s and "\\" not in s
    return f"'{s}'"


_D = "CAST(doc_id AS STRING)"
_PARTS = [
    _lit("<!DOCTYPE html><html"), _on("doc_id % 9 <> 0", "' lang=\"' || lang || '\"'"),
    _lit('><head><meta charset="utf-8"><script>var bait = "<body class=x>"; track(1);</script>'),
    _on("doc_id % 13 = 0", "''"),
    _on("doc_id % 13 <> 0 AND doc_id % 4 = 0", _lit("<title>Free Live Workshop | Acme Labs</title>")),
    _on("doc_id % 13 <> 0 AND doc_id % 4 = 1", _lit("<title>Thank you &amp; next steps</title>")),
    _on("doc_id % 13 <> 0 AND doc_id % 4 = 2", f"'<title>' || substr({_T}, 1, 30) || ' - Bright Coaching</title>'"),
    _on("doc_id % 13 <> 0 AND doc_id % 4 = 3", _lit("<title>Apply now</title>")),
    _on("doc_id % 3 <> 0", f"'<meta name=\"description\" content=\"Offer ' || {_D} || ' for founders\">'"),
    _on("doc_id % 4 = 0", "'<link rel=\"canonical\" href=\"' || url || '\">'"),
    _on("doc_id % 4 = 1", _lit('<link rel="canonical" href="/other/">')),
    _on("doc_id % 7 = 0", _lit("<meta name=robots content=\"NOINDEX, follow\">")),
    _on("doc_id % 5 <> 0", _lit('<meta name="viewport" content="width=device-width">')),
    _on("doc_id % 6 = 0", _lit('<meta property="og:title" content="Acme offer"><meta property="og:site_name" content="Acme Labs"><meta property="twitter:card" content="summary">')),
    _on("doc_id % 8 = 0", f"'<script type=\"application/ld+json\">{{\"@context\":\"https://schema.org\",\"@graph\":[{{\"@type\":\"Organization\",\"name\":\"Acme ' || source || '\",\"address\":{{\"@type\":\"PostalAddress\",\"streetAddress\":\"12 Main St\",\"addressLocality\":\"Springfield\"}}}},{{\"@type\":\"FAQPage\",\"mainEntity\":[{{\"@type\":\"Question\",\"name\":\"What is ' || {_D} || '?\",\"acceptedAnswer\":{{\"@type\":\"Answer\",\"text\":\"A course.\"}}}}]}},{{\"@type\":\"Review\",\"reviewBody\":\"This program doubled our revenue in six months and it is worth it\"}}]}}</script>'"),
    _on("doc_id % 8 = 1", _lit('<script type="application/ld+json">{"@type": broken</script>')),
    _on("doc_id % 10 = 0", f"'<script src=\"https://www.googletagmanager.com/gtm.js?id=GTM-A' || {_D} || 'BC\"></script>'"),
    _on("doc_id % 10 = 1", f"'<script async src=\"https://www.googletagmanager.com/gtag/js?id=G-ABC' || {_D} || 'XYZ\"></script><script>gtag(\"config\", \"G-ABC' || {_D} || 'XYZ\");</script>'"),
    _on("doc_id % 10 = 2", f"'<script>fbq(\"init\", \"123456' || {_D} || '\"); fbq(\"track\", \"PageView\");</script><script src=\"//connect.facebook.net/en_US/fbevents.js\"></script>'"),
    _on("doc_id % 10 = 3", _lit('<script src="https://static.hotjar.com/c/hotjar-1.js"></script><script src="https://static.hotjar.com/c/hotjar-2.js"></script>')),
    _on("doc_id % 10 = 4", _lit('<script src="/assets/app.js"></script><script>window.posthog = init();</script>')),
    _on("doc_id % 97 = 5", "repeat('<meta name=\"x\" content=\"y\">', 310)"),
    _lit("</head><body>"),
    _lit('<header><nav><a href="/">Acme Labs</a>'),
    "repeat('<a href=\"/about\">About</a><a href=\"/blog?p=1\">Blog</a>', CAST(doc_id % 3 AS INT))",
    _on("doc_id % 9 > 4", _lit('<a href="/pricing">Pricing</a><a href="/team">Team</a><a href="/jobs">Careers</a><a href="/docs">Docs</a><a href="/news">News</a><a href="/faq">FAQ</a><a href="https://status.other.org/x">Status</a>')),
    _lit("</nav></header><main>"),
    _lit('<section id="hero">'),
    _on("doc_id % 12 <> 0", _lit("<h1>Get more clients for busy coaches</h1>")),
    _on("doc_id % 12 = 1", _lit("<h1>Second promise</h1>")),
    _on("doc_id % 4 = 2", f"'<h2>' || substr({_T}, 1, 60) || '</h2>'"),
    _on("doc_id % 4 = 3", _lit("<h4>Skipped level heading</h4>")),
    _lit('<p class="subtitle">A 6-week coaching program built for agency owners using our 5-step system.</p>'),
    _on("doc_id % 5 = 0", _lit('<a class="btn" href="https://calendly.com/acme/intro">Book a call</a>')),
    _on("doc_id % 5 = 1", _lit('<a class="btn" href="#apply">Apply now</a>')),
    _on("doc_id % 5 = 2", _lit('<a class="btn" href="/checkout?x=1">Buy now</a><a href="https://buy.stripe.com/abc">Get instant access</a>')),
    _on("doc_id % 5 = 3", _lit('<a class="btn" href="https://acme.typeform.com/to/Ab12">Start your trial</a>')),
    _on("doc_id % 5 = 4 AND doc_id % 3 <> 0", _lit("<button>Get started</button>")),
    _on("doc_id % 6 = 0", _lit('<iframe src="https://www.youtube.com/embed/abcdefghijk?autoplay=1&amp;mute=1" width="640" height="360" title="Watch"></iframe>')),
    _on("doc_id % 6 = 1", _lit('<iframe data-src="https://player.vimeo.com/video/12345678"></iframe>')),
    _on("doc_id % 6 = 2", _lit('<video controls poster="/p.jpg"><source src="/v.mp4"></video>')),
    _on("doc_id % 6 = 3", _lit('<div class="video-wrap" data-video-id="wistia-abc"><button class="play">Play video</button></div>')),
    _on("doc_id % 11 = 3", _lit('<iframe src="https://calendly.com/acme/30min" title="Pick a time"></iframe>')),
    _lit("</section>"),
    _on("doc_id % 4 = 0", _lit("<section><h2>What you will learn</h2><ul><li>How to fill a calendar every week<li>Why most funnels leak<li>Pricing that holds up<ul><li>Anchors and tiers</li></ul></li></ul><h3>Bonus for people who show up</h3><p>Bonus when you attend: the private template library.</p></section>")),
    _on("doc_id % 3 = 0", "'<p>Only $' || CAST(97 + doc_id % 50 AS STRING) || ' today, normally $497.</p>'"),
    _on("doc_id % 3 = 1", _lit("<p>Or 3 payments of €49.00 per month. Save 20% off with code.</p>")),
    _on("doc_id % 24 = 0", _lit("<p>Founder seat price is $97</p><p>Founder seat price is $147</p>")),
    _on("doc_id % 4 = 1", _lit('<section><h2>What our clients say</h2><blockquote>"This program doubled our revenue in six months and it is worth it"</blockquote><p>- Jane Doe, CEO of Acme Labs</p><p>Rated 4.8 out of 5 stars by 12,400 students</p><p>We were lost before this and gained 40 clients after one quarter of work.</p></section>')),
    _on("doc_id % 4 = 3", _lit("<p>As seen in Forbes and TechCrunch. Revenue of $2 million generated, 3x growth and a 45% conversion rate increase.</p><p>Certified experts with over 12 years of experience.</p><p>Secure payment, 256-bit encryption.</p>")),
    _on("doc_id % 5 = 0", _lit("<p>Enjoy a 30-day money-back guarantee. Try it free!</p>")),
    _on("doc_id % 5 = 1", _lit("<p>Sorry, we do not offer refunds. All sales are final.</p>")),
    _on("doc_id % 5 = 2", _lit("<p>See our refund policy | Cancel anytime with no risk</p>")),
    _on("doc_id % 6 = 0", _lit('<p>Only 7 spots left. Doors close March 14, 2026! The sale ends March 14. Later the sale ends 15 April 2026.</p><div class="countdown" id="clock">00:12:33</div>')),
    _on("doc_id % 6 = 4", _lit("<p>Hurry, last chance. Registration ends tonight.</p><p>Is this for me? Even if you have tried everything, no risk.</p>")),
    _on("doc_id % 7 = 0", _lit("<section><h2>Frequently asked questions</h2><h3>Is it expensive?</h3><p>Not compared with the cost of doing nothing.</p><h3>How much time does it take?</h3><p>Two hours a week.</p><p>Can I get help?</p><p>Yes, every day.</p></section>")),
    _on("doc_id % 7 = 3", _lit("<p>You will get everything below</p><p>Weekly live coaching sessions</p><p>Private community access</p><p>A toolkit of templates</p><h3>More</h3>")),
    _on("doc_id % 4 = 2", _lit('<img src="/a1.png"><img src="/a2.png"><img src="/a3.png"><img src="/a4.png"><img src="/a5.png" alt=""><img src="/px.gif" width="1" height="1">')),
    _on("doc_id % 4 <> 2", _lit('<img src="/logo.png" alt="Acme Labs logo" width="120" height="40"><img src="/visa.svg" alt="Visa and PayPal" width="60" height="30">')),
    _on("doc_id % 6 = 0", _lit('<div><h3>Join free</h3><form id="optin" action="https://acme.activehosted.com/f/1" method="POST"><input type="hidden" name="token" value="s3cret-token-9"><label for="em">Email address</label><input id="em" type="email" name="email" required><input name="fname" placeholder="First name"><button>Get the free guide</button></form></div>')),
    _on("doc_id % 6 = 1", _lit('<article><h2>Apply</h2><form name="app" action="/apply"><label>Full name <input name="full_name"></label><input type="tel" name="phone" aria-label="Phone number"><span>Revenue</span><select name="revenue" required><option value="">Pick one</option><option>0-10k<option>10k+</select><textarea name="notes" placeholder="Tell us more">x</textarea><input type="radio" name="size" value="small"><input type="radio" name="size" value="large" checked><input type="checkbox" name="agree" aria-labelledby="t1 t2"><i id="t1">I agree</i> <i id="t2">to terms</i><input type="submit" value="Submit application"></form></article>')),
    _on("doc_id % 6 = 2", _lit('<form id="pay" action="/order"><input name="card" autocomplete="cc-number"><input name="cvc"><input type="email" name="email"><button type="submit">Pay now</button><iframe src="https://js.stripe.com/v3/el"></iframe></form>')),
    _on("doc_id % 6 = 3", _lit('<form action="/search"><input type="search" name="q"></form><form action="/login" method="post"><input name="username" autocomplete="username"><input type="password" name="password" value="hunter2"><button>Log in</button></form>')),
    _on("doc_id % 6 = 4", _lit('<div class="lead-form"><input type="email" name="email" placeholder="Your email"><input type="hidden" name="csrf" value="tok-778"><select name="c"><option>A<option>B</select><button type="submit">Submit</button></div>')),
    _on("doc_id % 10 = 5", _lit('<div class="modal popup" style="display:none"><h1>Hidden promise</h1><form id="pop"><input type="email" name="e2"><input type="submit" value="Join"></form></div>')),
    _on("doc_id % 10 = 6", _lit('<div id="cookie-banner" role="dialog"><p>We use cookies and similar tracking technologies.</p><button>Accept all</button><a href="/privacy">Privacy policy</a></div>')),
    f"'<article><p>' || replace({_T}, chr(10), '</p><p>') || '</p></article>'",
    _on("doc_id % 8 = 3", _lit("<p>You are scheduled with Maria Lopez on Tuesday, March 3, 2026 at 10:30 am EST for 30 minutes.</p><p>Next step: check your email before the call.</p><a href=\"https://zoom.us/j/123\">Join</a><a href=\"/event.ics\">Add to calendar</a>")),
    _lit('</main><footer><p>Phone: +1 (555) 010-9999 or call us at 555 123 4567</p><p>'),
    f"'Contact sales' || {_D} || '@' || source || '.example.com'",
    _lit('</p><a href="mailto:Info%40Acme.com?subject=x">Mail</a><a href="tel:+15550109999">Call</a><a href="https://www.facebook.com/acme">Facebook</a><a href="https://twitter.com/acme">Twitter</a><a href="https://m.youtube.com/@acme">YouTube</a><a href="../legal/./terms.html#top">Terms</a><a href="javascript:void(0)">Menu</a><a href="#">Top</a><a href="#hero">Back to top</a>'),
    _on("doc_id % 3 = 2", _lit('<a href="https://calendly.com/acme/intro">Book a call</a>')),
    _lit("<p>&copy; 2024-2025 Acme Labs LLC. All rights reserved. 44 Oak Hill Road</p></footer>"),
    _on("doc_id % 17 <> 0", _lit("</body></html>")),
]

URL_EXPR = (
    "'http' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE 's' END || '://www.' || source || "
    "CASE doc_id % 3 WHEN 0 THEN '.example.com' WHEN 1 THEN '.example.co.uk' ELSE '.shop.example.org' END || '/' || lang || "
    "CASE doc_id % 8 WHEN 0 THEN '/webinar' WHEN 1 THEN '/thank-you/' WHEN 2 THEN '/checkout' WHEN 3 THEN '/confirm?id=1' "
    "WHEN 4 THEN '/apply#top' WHEN 5 THEN '/offer' ELSE '/p' || CAST(doc_id AS STRING) END"
)
HTML_EXPR = " || ".join(_PARTS)
LANDING_SQL = (
    f"SELECT doc_id AS page_id, url, {HTML_EXPR} AS html FROM (SELECT *, {URL_EXPR} AS url FROM documents) d"
)

# Geometry of the stand-in renderer: one token is 10 pixels tall on a 1280 x 900 screen.
VIEWPORT = {"width": 1280, "height": 900, "scroll_width": 1280, "scroll_height": 6000}
ROW_PX = 10


def landing_pages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return docs.withColumn("url", F.expr(URL_EXPR)).select(
        F.col("doc_id").alias("page_id"), "url", F.expr(HTML_EXPR).alias("html")
    )


def web_pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")
