"""Third-party hosts: embeds, schedulers, players, trackers, parties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelode.functions import urls as U
from pagelode.functions.base import blank_to_null, c, chain, ext, has, let, txt

# Hosts that serve embedded forms and calendars.
FORM_EMBED = (
    r"(?i)typeform\.com|form\.typeform|jotform\.com|forms\.gle|docs\.google\.com/forms|google\.com/forms|tally\.so"
    r"|fillout\.com|paperform\.co|leadconnectorhq\.com|msgsndr\.com|gohighlevel\.com|form-builder\.gohighlevel"
)
CALENDAR_EMBED = (
    r"(?i)calendly\.com|cal\.com|acuityscheduling\.com|tidycal\.com|hubspot\.com/meetings|calendar\.google\.com"
    r"|outlook\.office|savvycal\.com|oncehub\.com|scheduleonce\.com|youcanbook\.me|appointlet\.com|koalendar\.com"
    r"|zcal\.co|chilipiper\.com|leadconnectorhq\.com/widget/(?:booking|bookings)|msgsndr\.com/widget/(?:booking|bookings)"
)
# Provider by substring of the lower-cased address, first hit wins.
EMBED_PROVIDERS = [
    (["typeform"], "typeform"), (["jotform"], "jotform"), (["tally.so"], "tally"), (["fillout.com"], "fillout"),
    (["paperform"], "paperform"), (["google.com/forms", "docs.google.com/forms", "forms.gle"], "google_forms"),
    (["leadconnector", "msgsndr", "gohighlevel"], "gohighlevel"), (["calendly"], "calendly"), (["cal.com"], "cal.com"),
    (["acuity"], "acuity"), (["tidycal"], "tidycal"), (["hubspot.com/meetings"], "hubspot_meetings"),
    (["savvycal"], "savvycal"), (["oncehub", "scheduleonce"], "oncehub"), (["youcanbook.me"], "youcanbookme"),
    (["appointlet"], "appointlet"), (["koalendar"], "koalendar"), (["zcal.co"], "zcal"), (["chilipiper"], "chilipiper"),
    (["calendar.google.com"], "google_calendar"),
]
# Video hosts by substring, first hit wins.
VIDEO_PROVIDERS = [
    (["youtube", "youtu.be", "ytimg"], "youtube"), (["vimeo"], "vimeo"), (["wistia", "wi.st"], "wistia"),
    (["loom.com"], "loom"), (["vidalytics"], "vidalytics"), (["bunnycdn", "mediadelivery"], "bunny"),
    (["jwplatform", "jwpcdn"], "jwplayer"), (["brightcove"], "brightcove"),
]
NOT_VIDEO_FRAME = (
    r"(?i)typeform\.com|jotform\.com|tally\.so|fillout\.com|paperform|forms\.gle|google\.com/forms|calendly\.com"
    r"|cal\.com|acuityscheduling|tidycal|hubspot\.com/meetings"
)
VIDEO_SRC = r"(?i)youtube|youtu\.be|vimeo|wistia|loom|vidalytics|jwplayer|brightcove|/video|player\."
# Address shapes that carry a video id.
VIDEO_IDS = {
    "youtube": r"(?:youtube(?:-nocookie)?\.com/(?:embed|v)/|youtu\.be/|[?&]v=)([A-Za-z0-9_-]{11})(?:[^A-Za-z0-9_-]|$)",
    "vimeo": r"vimeo\.com/(?:video/)?(\d{6,})(?:\D|$)",
    "wistia": r"wistia\.(?:com|net)/(?:[A-Za-z0-9_-]+/)*(?:medias|iframe)/([A-Za-z0-9]{6,})(?:[^A-Za-z0-9]|$)",
    "loom": r"loom\.com/(?:embed|share)/([A-Za-z0-9]{8,})(?:[^A-Za-z0-9]|$)",
}

# Window globals looked for.
TRACKING_GLOBALS = [
    "fbq", "gtag", "dataLayer", "ga", "_gaq", "ttq", "twq", "snaptr", "pintrk", "lintrk", "rdt", "hj", "clarity",
    "analytics", "Intercom", "drift", "$crisp", "tidioChatApi", "posthog", "mixpanel", "amplitude", "_learnq",
    "wistiaTracker",
]
VENDOR_GLOBALS = TRACKING_GLOBALS + [
    "Calendly", "Cal", "SavvyCal", "Chilipiper", "hbspt", "HubSpotConversations", "Typeform", "tf", "JotForm",
    "Tally", "Paperform", "gform", "Wistia", "_wq", "Vimeo", "YT", "vidalytics", "jwplayer", "videojs", "jQuery",
    "$", "React", "ReactDOM", "Vue", "angular", "Alpine", "Turbo", "htmx", "Shopify", "Stripe", "paypal",
    "Rewardful", "ThriveCart", "Kajabi", "Klaviyo", "Mailchimp", "_kmq", "Beacon", "zE", "Tawk_API",
    "LiveChatWidget", "olark", "Podium", "Chatra", "HubSpot", "Marketo", "MktoForms2", "elementorFrontend", "wp",
    "webflow", "Squarespace", "Wix", "unbounce", "google_tag_manager", "Sentry", "newrelic", "Optimizely", "VWO",
    "_vwo_code",
]
# A global as inline code names it: window.X = / window.X( or a bare call X(.
GLOBAL_USE = r"(?:window\.|^|[\s;{(,!])([A-Za-z_$][A-Za-z0-9_$]*)\s*(?:=[^=]|\()"

# Tracking vendors as (vendor, kind, script address, inline code, global name).
VENDORS = [
    ("Meta Pixel", "pixel", r"(?i)connect\.facebook\.net", r"(?i)fbq\s*\(", "^fbq$"),
    ("Google Tag Manager", "tag_manager", r"(?i)googletagmanager\.com/gtm\.js", "GTM-[A-Z0-9]+", "^dataLayer$"),
    ("Google Analytics 4", "analytics", r"(?i)googletagmanager\.com/gtag/js", r"(?i)gtag\s*\(\s*['\"]config", "^gtag$"),
    ("Google Analytics (Universal)", "analytics", r"(?i)google-analytics\.com/analytics\.js", r"(?i)ga\s*\(\s*['\"]create", "^_?gaq?$"),
    ("Google Ads Conversion", "pixel", None, r"AW-\d{6,}", None),
    ("TikTok Pixel", "pixel", r"(?i)analytics\.tiktok\.com", r"(?i)ttq\.", "^ttq$"),
    ("X (Twitter) Pixel", "pixel", r"(?i)static\.ads-twitter\.com", None, "^twq$"),
    ("Snap Pixel", "pixel", r"(?i)sc-static\.net/scevent", None, "^snaptr$"),
    ("Pinterest Tag", "pixel", r"(?i)s\.pinimg\.com/ct", None, "^pintrk$"),
    ("LinkedIn Insight", "pixel", r"(?i)snap\.licdn\.com", None, "^lintrk$"),
    ("Reddit Pixel", "pixel", r"(?i)redditstatic\.com/ads", None, "^rdt$"),
    ("Hotjar", "heatmap", r"(?i)static\.hotjar\.com", None, "^hj$"),
    ("Microsoft Clarity", "heatmap", r"(?i)clarity\.ms", None, "^clarity$"),
    ("Segment", "analytics", r"(?i)cdn\.segment\.com", None, "^analytics$"),
    ("PostHog", "analytics", r"(?i)posthog\.com", None, "^posthog$"),
    ("Mixpanel", "analytics", r"(?i)cdn\.mxpnl\.com", None, "^mixpanel$"),
    ("Amplitude", "analytics", r"(?i)amplitude\.com", None, "^amplitude$"),
    ("Klaviyo", "analytics", r"(?i)static\.klaviyo\.com", None, "^_learnq$"),
    ("Intercom", "chat", r"(?i)widget\.intercom\.io", None, "^Intercom$"),
    ("Drift", "chat", r"(?i)js\.driftt\.com", None, "^drift$"),
    ("Crisp", "chat", r"(?i)client\.crisp\.chat", None, r"^\$crisp$"),
    ("Tidio", "chat", r"(?i)code\.tidio\.co", None, "^tidioChatApi$"),
    ("Hyros", "pixel", r"(?i)hyros\.com|t\.hyros", None, None),
    ("Wicked Reports", "pixel", r"(?i)wickedreports\.com", None, None),
    ("Triple Whale", "analytics", r"(?i)triplewhale\.com", None, None),
    ("HubSpot", "analytics", r"(?i)js\.hs-scripts\.com|js\.hsforms\.net", None, None),
    ("Cloudflare Web Analytics", "analytics", r"(?i)static\.cloudflareinsights\.com|cloudflareinsights\.com/beacon", None, None),
    ("Plausible", "analytics", r"(?i)plausible\.io/js", None, None),
    ("Fathom", "analytics", r"(?i)cdn\.usefathom\.com", None, None),
    ("Matomo", "analytics", r"(?i)matomo\.(cloud|org)|piwik", None, "^_paq$"),
    ("Vercel Analytics", "analytics", r"(?i)/_vercel/insights", None, None),
    ("GoHighLevel", "other", r"(?i)leadconnectorhq\.com|msgsndr\.com", None, None),
]
# Vendor slugs and categories that differ from the slugged name and the kind.
VENDOR_SLUGS = {"Google Ads Conversion": "google_ads", "X (Twitter) Pixel": "x_pixel"}
VENDOR_CATEGORIES = {"Hyros": "attribution", "Wicked Reports": "attribution", "Triple Whale": "attribution"}
KIND_CATEGORY = {"pixel": "advertising_pixel"}
# Account ids as (vendor slug, pattern, group, text the script must also hold).
ID_PATTERNS = [
    ("google_tag_manager", r"\bGTM-[A-Z0-9]{4,10}\b", 0, None),
    ("google_analytics_4", r"\bG-[A-Z0-9]{6,12}\b", 0, r"(?i)gtag|googletagmanager|google-?analytics"),
    ("google_analytics_universal", r"\bUA-\d{4,10}-\d{1,4}\b", 0, None),
    ("google_ads", r"\bAW-\d{6,12}\b", 0, None),
    ("meta_pixel", r"fbq\s*\(\s*['\"]init['\"]\s*,\s*['\"](\d{6,20})['\"]", 1, None),
    ("meta_pixel", r"(?i)facebook\.com/tr\?[^\"'\s]*\bid=(\d{6,20})", 1, None),
    ("tiktok_pixel", r"ttq\.load\s*\(\s*['\"]([A-Za-z0-9_-]{6,40})['\"]", 1, None),
    ("linkedin_insight", r"_linkedin_partner_id\s*=\s*[\"']?(\d{3,12})", 1, None),
    ("linkedin_insight", r"_linkedin_data_partner_ids\.push\s*\(\s*[\"']?(\d{3,12})", 1, None),
]
# Statement families as (label, vendors, slugs).
STATEMENT_FAMILIES = [
    ("Google Analytics", ["Google Analytics 4", "Google Analytics (Universal)"], ["google_analytics_4", "google_analytics_universal"]),
    ("Google Tag Manager", ["Google Tag Manager"], ["google_tag_manager"]),
    ("Meta Pixel", ["Meta Pixel"], ["meta_pixel"]),
    ("Google Ads conversion tracking", ["Google Ads Conversion"], ["google_ads"]),
    ("TikTok Pixel", ["TikTok Pixel"], ["tiktok_pixel"]),
    ("LinkedIn Insight Tag", ["LinkedIn Insight"], ["linkedin_insight"]),
]

# Platforms a native form posts to, by host suffix; WordPress by path.
PLATFORM_HOSTS = [
    ("typeform", ["typeform.com"]), ("jotform", ["jotform.com", "jotform.co", "jotformeu.com"]), ("tally", ["tally.so"]),
    ("fillout", ["fillout.com"]), ("gohighlevel", ["leadconnectorhq.com", "msgsndr.com", "gohighlevel.com"]),
    ("hubspot", ["hsforms.com", "hsforms.net", "hubspot.com", "hubapi.com", "hs-sites.com"]),
    ("activecampaign", ["activehosted.com", "activecampaign.com"]),
    ("convertkit", ["convertkit.com", "ck.page", "convertkit-mail.com"]),
    ("mailchimp", ["list-manage.com", "mailchimp.com", "mailchi.mp"]), ("klaviyo", ["klaviyo.com", "kmail-lists.com"]),
    ("clickfunnels", ["clickfunnels.com", "myclickfunnels.com"]), ("kajabi", ["kajabi.com", "mykajabi.com"]),
    ("kartra", ["kartra.com"]), ("systeme.io", ["systeme.io"]), ("webflow", ["webflow.com", "webflow.io"]),
    ("wordpress", ["wordpress.com"]),
]
WORDPRESS_PATHS = [
    "/wp-admin/admin-ajax.php", "/wp-comments-post.php", "/wp-json/contact-form-7", "/wp-content/", "/wp-json/wp/",
]
# The older action test used by role-aware analysis.
ACTION_PROVIDERS = [
    (r"(?i)activehosted\.com|activecampaign", "activecampaign"), (r"(?i)convertkit|kit\.com", "convertkit"),
    (r"(?i)mailchimp|list-manage\.com", "mailchimp"), (r"(?i)hubspot", "hubspot"), (r"(?i)klaviyo", "klaviyo"),
    (r"(?i)clickfunnels", "clickfunnels"), (r"(?i)kajabi", "kajabi"), (r"(?i)kartra", "kartra"),
    (r"(?i)systeme\.io", "systeme_io"), (r"(?i)gohighlevel|leadconnector|msgsndr", "gohighlevel"),
    (r"(?i)webflow", "webflow"), (r"(?i)wpforms|wp-json|admin-ajax\.php", "wordpress"),
]

# Checkout hosts and paths.
CHECKOUT_HOSTS = (
    r"(?i)(^|\.)(checkout|buy)\.stripe\.com|(^|\.)paypal\.com|(^|\.)paddle\.com|(^|\.)lemonsqueezy\.com"
    r"|(^|\.)gumroad\.com|(^|\.)thrivecart\.com|(^|\.)samcart\.com|(^|\.)snipcart\.com|(^|\.)chargebee\.com"
    r"|(^|\.)recurly\.com|(^|\.)fastspring\.com|(^|\.)2checkout\.com|(^|\.)checkout\.square\.site"
)
CHECKOUT_PATHS = r"(?i)/(checkout|cart|order[-_]?form|purchase|payment)(/|\?|#|$)"

# Where a technical event came from.
SECURITY_HOSTS = (
    r"(?i)(^|\.)challenges\.cloudflare\.com$|(^|\.)hcaptcha\.com$|(^|\.)recaptcha\.net$|(^|\.)gstatic\.com$"
    r"|(^|\.)google\.com$|(^|\.)arkoselabs\.com$|(^|\.)perimeterx\.net$|(^|\.)px-cloud\.net$|(^|\.)datadome\.co$"
    r"|(^|\.)funcaptcha\.com$|turnstile"
)
ANALYTICS_HOSTS = (
    r"(?i)(^|\.)google-analytics\.com$|(^|\.)googletagmanager\.com$|(^|\.)analytics\.google\.com$|(^|\.)doubleclick\.net$"
    r"|(^|\.)facebook\.(com|net)$|(^|\.)connect\.facebook\.net$|(^|\.)tiktok\.com$|(^|\.)analytics\.tiktok\.com$"
    r"|(^|\.)snap\.licdn\.com$|(^|\.)linkedin\.com$|(^|\.)hotjar\.(com|io)$|(^|\.)clarity\.ms$|(^|\.)segment\.(io|com)$"
    r"|(^|\.)mixpanel\.com$|(^|\.)amplitude\.com$|(^|\.)posthog\.com$|(^|\.)cloudflareinsights\.com$|(^|\.)plausible\.io$"
    r"|(^|\.)matomo\.cloud$|(^|\.)sentry\.io$|(^|\.)bugsnag\.com$"
)
BROWSER_NOISE = (
    r"(?i)third-party cookie|will be blocked|is deprecated|Deprecation|violates the following Content Security Policy"
    r"|was preloaded using link preload|Failed to load resource: net::ERR_(BLOCKED_BY_CLIENT|CACHE)"
    r"|Slow network is detected|favicon"
)
REQUEST_NOISE = (
    r"(?i)google-analytics\.com|googletagmanager\.com/gtag|facebook\.com/tr|doubleclick\.net|hotjar\.com|clarity\.ms"
    r"|segment\.io|sentry\.io|youtube\.com/(?:api/stats|youtubei)|googlevideo\.com|\.gif\?|favicon\.(?:ico|png)"
)
CONSOLE_NOISE = r"(?i)third-party cookie|will be blocked|deprecat|ERR_BLOCKED_BY_CLIENT|preload"


def is_form_embed(u: Column | str) -> Column:
    return has(u, FORM_EMBED)


def is_calendar_embed(u: Column | str) -> Column:
    return has(u, CALENDAR_EMBED)


def _by_substring(low: Column, table) -> list[tuple[Column, str]]:
    cases = []
    for needles, name in table:
        cond = low.contains(needles[0])
        for n in needles[1:]:
            cond = cond | low.contains(n)
        cases.append((cond, name))
    return cases


def embed_provider(u: Column | str) -> Column:
    def read(low: Column) -> Column:
        name = chain(_by_substring(low, EMBED_PROVIDERS))
        booking = low.rlike("widget/(?:booking|bookings)")
        return F.when((name == "gohighlevel") & booking, F.lit("gohighlevel_calendar")).otherwise(name)

    return let(F.lower(c(u)), read)


def scheduler_provider(u: Column | str) -> Column:
    return F.when(is_calendar_embed(u), F.coalesce(embed_provider(u), F.lit("scheduler")))


def video_provider(src: Column | str) -> Column:
    return let(F.lower(txt(c(src))), lambda low: chain(_by_substring(low, VIDEO_PROVIDERS), F.lit("unknown")))


def video_id(provider: Column | str, src: Column | str) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in VIDEO_IDS.items():
        out = F.when(c(provider) == name, ext(src, pattern, 1)).otherwise(out)
    return out


def form_provider(action: Column | str, page_url: Column | str) -> Column:
    """Platform behind a native form: host suffix first, then WordPress paths, else native."""

    def read(url: Column) -> Column:
        where = F.struct(U.bare_host(url).alias("host"), F.lower(U.path(url)).alias("path"))
        return F.when(url.isNull(), F.lit("unknown")).otherwise(let(where, named))

    def named(where: Column) -> Column:
        h, p = where["host"], where["path"]
        cases = []
        for name, suffixes in PLATFORM_HOSTS:
            cond = F.lit(False)
            for s in suffixes:
                cond = cond | (h == s) | h.endswith("." + s)
            cases.append((cond, name))
        wp = F.lit(False)
        for frag in WORDPRESS_PATHS:
            wp = wp | p.contains(frag)
        return chain(cases + [(wp, "wordpress")], F.lit("native"))

    return let(U.resolve_url(blank_to_null(c(action)), page_url), read)


def action_provider(action: Column | str) -> Column:
    """Older reading used by role-aware analysis: any part of the action counts."""
    a = c(action)
    known = chain([(has(a, p), n) for p, n in ACTION_PROVIDERS], F.lit("native"))
    return F.when(txt(a) == "", F.lit("native")).otherwise(F.coalesce(embed_provider(a), known))


def _vendor_for(h: Column) -> Column:
    def read(root: Column) -> Column:
        return chain([
            (root.endswith("cloudflare.com") & h.contains("challenges."), "Cloudflare Turnstile"),
            (root.endswith("cloudflare.com"), "Cloudflare"),
            (root.endswith("cloudflareinsights.com"), "Cloudflare Web Analytics"),
            (root.endswith("hcaptcha.com"), "hCaptcha"),
            (root.rlike(r"recaptcha\.net$|google\.com$|gstatic\.com$"), "Google reCAPTCHA"),
            (root.endswith("googletagmanager.com"), "Google Tag Manager"),
            (root.endswith("google-analytics.com"), "Google Analytics"),
            (root.rlike(r"facebook\.(com|net)$"), "Meta"),
        ])

    return let(U.registrable_host(h), read)


def classify_party(src: Column | str, page_url: Column | str, message: Column | str | None = None) -> Column:
    """struct(party, host, vendor) of an event, relative to the page it happened on."""
    noise = has(message, BROWSER_NOISE) if message is not None else F.lit(False)
    page = U.registrable_host(U.host(page_url))

    def read(h: Column) -> Column:
        party = chain([
            (h.isNull() & noise, "browser"),
            (h.isNull(), "unknown"),
            (has(h, SECURITY_HOSTS), "security_infrastructure"),
            (has(h, ANALYTICS_HOSTS), "analytics"),
            ((page != "") & (U.registrable_host(h) == page), "first_party"),
            (noise, "browser"),
        ], F.lit("third_party"))
        named = lambda p: F.struct(
            p.alias("party"), h.alias("host"),
            F.when(p.isin("security_infrastructure", "analytics", "third_party"), _vendor_for(h)).alias("vendor"),
        )
        return let(party, named)

    return let(U.host(src), read)


def is_noise(url: Column | str) -> Column:
    return has(url, REQUEST_NOISE)


def is_console_noise(message: Column | str) -> Column:
    return has(message, CONSOLE_NOISE)


def link_outcome(status: Column | str, ranged: Column | None = None, declined: Column | None = None) -> Column:
    """struct(outcome, ok) of a probe: an answer we may not see is not a broken link."""
    s = c(status)
    ranged = F.lit(False) if ranged is None else ranged
    declined = F.lit(False) if declined is None else declined
    outcome = chain([
        (s.isNull(), "unreachable"),
        ((s < 400) | declined | ((s == 416) & ranged), "ok"),
        (s.isin(401, 403, 429, 999), "blocked"),
    ], F.lit("broken"))
    return let(outcome, lambda o: F.struct(o.alias("outcome"), o.isin("ok", "blocked").alias("ok")))
