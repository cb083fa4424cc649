"""Prices in copy: tokens, amounts, currencies and the wording right around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelode.functions.base import c, chain, ext, ext_all, has, let, sub, txt

# Price tokens and the wording read around them. A bare run such as $1200 is
# read three digits at a time ($120), as the token pattern says.
PRICE = (
    r"(?:USD|CAD|AUD|GBP|EUR|\$|£|€)\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?"
    r"|\d{1,3}(?:,\d{3})*(?:\.\d{2})?\s?(?:USD|CAD|AUD|GBP|EUR)"
)
ORIGINAL_PRICE = r"(?i)(?:was|normally|regularly|original(?:ly)?)\s*((?:USD|\$|£|€)\s?\d[\d,]*(?:\.\d{2})?)"
NOT_A_PRICE = r"copyright|©|\b19\d{2}\b|\b20\d{2}\b"
RECURRING = (
    r"(?i)(/\s*(?:mo|mon|month|yr|year|wk|week)\b)|\bper\s+(?:month|year|week|day|mo|yr)\b"
    r"|\b(?:monthly|yearly|annually|annual|weekly|recurring|subscription)\b|\ba\s+(?:month|year|week)\b"
)
# The multiplication form is followed by a currency sign or a digit, which is then dropped.
PAYMENT_PLAN = (
    r"(?i)\b\d{1,2}\s*(?:monthly\s+|easy\s+|simple\s+)?payments?\s+of\b|\b\d{1,2}\s*[x×]\s*(?=[$£€]|\d)"
    r"|\bpay\s+in\s+\d{1,2}\b|\b\d{1,2}\s+instal?lments?\b"
)
PRICE_DISCOUNT = r"(?i)\b(\d{1,3}\s*%\s*(?:off|discount)|save\s+(?:up\s+to\s+)?[$£€]?\d[\d,]*(?:\.\d{2})?)\b"
PAGE_DISCOUNT = r"(?i)\b(\d{1,3}%\s*off|save\s*\$?\d+|\d{1,3}%\s*discount)\b"
CURRENCY_CODE = r"(?i)\b(USD|CAD|AUD|GBP|EUR|NZD|CHF|SEK|INR)\b"
MULTI_PRICE = (
    r"(?i)\b(?:was|now|instead of|normally|regularly|original|originally|save|discount|off|from|starting|as low as"
    r"|reg\.?|value|worth|per|month|monthly|year|yearly|annual|annually|mo|yr|installments?|payments?|deposit|plan"
    r"|tier|package|billed|upgrade|add[- ]on)\b"
)
NEAR = 60


def price_tokens(s: Column | str) -> Column:
    return ext_all(s, PRICE)


def is_non_price(s: Column | str, amount: Column | str) -> Column:
    """Years and copyright lines without a dollar sign, and bare numbers between 0 and 2."""
    a = c(amount)
    num = sub(a, r"[^\d.]", "").try_cast("double")
    return (has(s, NOT_A_PRICE) & ~a.contains("$")) | (
        F.coalesce((num > 0) & (num < 2), F.lit(False)) & ~a.rlike(r"[.]\d{2}")
    )


def currency(amount: Column | str) -> Column:
    a = c(amount)
    return chain([
        (a.contains("$") | has(a, "(?i)USD"), "USD"),
        (a.contains("£") | has(a, "(?i)GBP"), "GBP"),
        (a.contains("€") | has(a, "(?i)EUR"), "EUR"),
    ])


def currency_stated(amount: Column | str, text: Column | str) -> Column:
    """An explicit code beats a symbol: `CAD $49` is CAD."""
    code = F.coalesce(ext(amount, CURRENCY_CODE, 1), ext(text, CURRENCY_CODE, 1))
    return F.coalesce(F.upper(code), currency(amount))


def parse_amount(amount: Column | str) -> Column:
    """Number behind either separator convention; NULL where the separators do not settle it."""

    def read(raw: Column) -> Column:
        commas = F.length(raw) - F.length(F.replace(raw, F.lit(","), F.lit("")))
        dots = F.length(raw) - F.length(F.replace(raw, F.lit("."), F.lit("")))
        drop = lambda ch: F.replace(raw, F.lit(ch), F.lit(""))
        both_dot = raw.rlike(r"^\d{1,3}(,\d{3})*\.\d*$")
        both_comma = raw.rlike(r"^\d{1,3}(\.\d{3})*,\d*$")
        number = (
            F.when((commas == 0) & (dots == 0), raw)
            .when((commas > 0) & (dots > 0), F.when(both_dot, drop(",")).when(
                both_comma, F.replace(drop("."), F.lit(","), F.lit("."))))
            .when((commas + dots) > 1, F.when(raw.rlike(r"^\d{1,3}([.,]\d{3})+$"), sub(raw, "[.,]", "")))
            .when(raw.rlike(r"^\d{1,3},\d{3}$"), drop(","))
            .when(raw.rlike(r"^0\.\d{3}$"), raw)
            .when(raw.rlike(r"[.,]\d{1,2}$"), F.replace(raw, F.lit(","), F.lit(".")))
        )
        return F.when(raw.rlike(r"^\d[\d.,]*\d$|^\d$"), number.try_cast("double"))

    return let(sub(c(amount), r"[^\d.,]", ""), read)


def near_price(text: Column | str, amount: Column | str) -> Column:
    """The part of a block that describes this price: its sentence, at most 60 characters away."""
    def read(p: Column) -> Column:
        t, a, at = p["t"], p["a"], p["at"]
        head = F.substring(t, F.lit(1), at)
        # One past the last break at or before the amount.
        start = F.length(F.regexp_extract(head, r"(?s)^(.*[.!?;•|\n])", 1)) + 1
        tail = F.substring(t, at + F.length(a), F.length(t))
        stop = F.length(F.regexp_extract(tail, r"^([^.!?;•|\n]*)", 1))
        lead = F.greatest(start, at - NEAR)
        return F.substring(t, lead, at - lead + F.length(a) + F.least(stop, F.lit(NEAR)))

    t, a = c(text), c(amount)
    parts = F.struct(
        t.alias("t"), a.alias("a"), F.position(a, t).alias("at")
    )
    return F.when(F.position(a, t) > 0, let(parts, read)).otherwise(F.when(F.length(t) <= 2 * NEAR, t).otherwise(F.lit("")))


def discount(s: Column | str, scope: str = "page") -> Column:
    return F.trim(ext(s, PAGE_DISCOUNT if scope == "page" else PRICE_DISCOUNT))


def amount_key(amount: Column | str, cur: Column | str) -> Column:
    digits = sub(txt(c(amount)), r"[^\d.]", "")
    value = digits.try_cast("double")
    return F.when(value.isNotNull(), F.concat(txt(c(cur)), F.lit(":"), value.cast("string")))
