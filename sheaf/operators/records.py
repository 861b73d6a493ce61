"""Record calculators as table jobs: change, share, units, tenure, contact payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sheaf.functions import ordered
from sheaf.functions.text import WS, col, is_blank, js_trim
from sheaf.functions.urls import website_url

# Multipliers to the base unit of each category.
LENGTH = {"mm": 0.001, "cm": 0.01, "m": 1.0, "km": 1000.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344}
WEIGHT = {"mg": 0.000001, "g": 0.001, "kg": 1.0, "oz": 0.028349523125, "lb": 0.45359237, "st": 6.35029318, "t": 1000.0}
TEMPERATURE = ("c", "f", "k")


def period_change(df: DataFrame, value: str, order: str, by: Sequence[str]) -> DataFrame:
    """Percent change against the preceding period of the same group, with direction."""
    d = ordered.with_previous(df, list(by), [order], [value])
    before = F.col("prev")[value]
    raw = (F.col(value) - before) / F.nullif(before, F.lit(0)) * 100
    percent = F.when(before == 0, F.lit(0.0)).otherwise(raw)
    direction = F.when(percent > 0, "increase").when(percent < 0, "decrease").when(percent == 0, "no-change").otherwise("first")
    return d.select(*by, order, value, percent.alias("percent"), direction.alias("direction"))


def percent_of(percent: Column, value: Column) -> Column:
    return percent / 100 * value


def share_of_whole(df: DataFrame, part: str, by: Sequence[str], whole_by: Sequence[str]) -> DataFrame:
    """Sum per group as a percentage of the sum of its whole; a zero whole gives NULL."""
    parts = df.groupBy(*whole_by, *by).agg(F.sum(part).alias("part"))
    whole = parts.groupBy(*whole_by).agg(F.sum("part").alias("whole"))
    d = parts.join(whole, list(whole_by)) if whole_by else parts.withColumn("k", F.lit(1)).join(
        whole.withColumn("k", F.lit(1)), "k").drop("k")
    return d.withColumn("percent", F.col("part") / F.nullif(F.col("whole"), F.lit(0)) * 100)


def unit_dimension(spark) -> DataFrame:
    rows = [("length", u, f) for u, f in LENGTH.items()] + [("weight", u, f) for u, f in WEIGHT.items()]
    rows += [("temperature", u, 1.0) for u in TEMPERATURE]
    return spark.createDataFrame(rows, "category string, unit string, to_base double")


def normalize_units(df: DataFrame, value: str, unit: str, target: str, category: str) -> DataFrame:
    """Add ``converted``: NULL for unknown units or non-finite values. The dimension has 18 fixed rows."""
    units = unit_dimension(df.sparkSession)
    a = units.select(F.col("category").alias(category), F.col("unit").alias(unit), F.col("to_base").alias("__a"))
    b = units.select(F.col("category").alias(category), F.col("unit").alias(target), F.col("to_base").alias("__b"))
    d = df.join(F.broadcast(a), [category, unit], "left").join(F.broadcast(b), [category, target], "left")
    v = F.col(value)
    celsius = F.when(F.col(unit) == "c", v).when(F.col(unit) == "f", (v - 32) * 5 / 9).when(F.col(unit) == "k", v - 273.15)
    out = F.when(F.col(target) == "c", celsius).when(F.col(target) == "f", celsius * 9 / 5 + 32).when(
        F.col(target) == "k", celsius + 273.15)
    known = F.col("__a").isNotNull() & F.col("__b").isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    converted = F.when(
        known, F.when(F.col(category) == "temperature", out).otherwise(v * F.col("__a") / F.col("__b"))
    )
    return d.select(*df.columns, converted.alias("converted"))


def display_number(value: Column) -> Column:
    """Decimals by magnitude (2, 3, 4, 6, 9), trailing zeros stripped."""
    a = F.abs(value)
    shown = (
        F.when(a >= 1000, F.format_string("%.2f", value)).when(a >= 100, F.format_string("%.3f", value))
        .when(a >= 1, F.format_string("%.4f", value)).when(a >= 0.01, F.format_string("%.6f", value))
        .otherwise(F.format_string("%.9f", value))
    )
    text = F.regexp_replace(F.regexp_replace(shown, "0+$", ""), r"\.$", "")
    return F.when(value.isNull() | F.isnan(value), "—").when(text.isin("0", "-0"), "0").otherwise(text)


def age_breakdown(df: DataFrame, start: str, as_of: str) -> DataFrame:
    """Add years, months, days, total_days, total_weeks, total_months, days_to_next.

    Days borrow the length of the month before ``as_of``; 29 February counts as 28 in other years.
    Rows that start after ``as_of`` get NULL and valid = false."""
    s, e = F.col(start), F.col(as_of)
    leap = lambda y: (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    feb29 = (F.month(s) == 2) & (F.day(s) == 29)
    day_in = lambda y: F.when(feb29 & ~leap(y), 28).otherwise(F.day(s))
    d0 = F.day(e) - day_in(F.year(e))
    borrow = d0 < 0
    days = F.when(borrow, d0 + F.day(F.last_day(F.add_months(F.trunc(e, "month"), -1)))).otherwise(d0)
    m0 = F.month(e) - F.month(s) - F.when(borrow, 1).otherwise(0)
    months = F.when(m0 < 0, m0 + 12).otherwise(m0)
    years = F.year(e) - F.year(s) - F.when(m0 < 0, 1).otherwise(0)
    total = F.datediff(e, s)
    at = lambda y: F.make_date(y, F.month(s), day_in(y))
    this_year = at(F.year(e))
    following = F.when(this_year <= e, at(F.year(e) + 1)).otherwise(this_year)
    valid = s <= e
    ok = lambda c: F.when(valid, c)
    return df.select(
        *df.columns, ok(years).alias("years"), ok(months).alias("months"), ok(days).alias("days"),
        ok(total).alias("total_days"), ok(F.floor(total / 7).cast("int")).alias("total_weeks"),
        ok(years * 12 + months).alias("total_months"), ok(F.datediff(following, e)).alias("days_to_next"),
        valid.alias("valid"),
    )


CONTACT_FIELDS = (
    "text url email email_subject email_body phone sms_phone sms_message wifi_ssid wifi_security "
    "wifi_password wifi_hidden vcard_name vcard_organization vcard_title vcard_phone vcard_email "
    "vcard_website vcard_address"
).split()
# Fixed patterns.
EMAIL = rf"^[^@\s\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}}]+@" \
        rf"[^@\s\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}}]+\." \
        rf"[^@\s\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}}]+\z"
PHONE = rf"^\+?(?:[0-9().-]|{WS}){{3,30}}\z"


def encode_query(value: Column) -> Column:
    """Percent-encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( ) as they are."""
    out = F.url_encode(value)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _query(*pairs: tuple[str, Column]) -> Column:
    shown = F.array(*[F.when(~is_blank(v), F.concat(F.lit(k + "="), encode_query(v))) for k, v in pairs])
    text = F.array_join(F.filter(shown, lambda x: x.isNotNull()), "&")
    return F.when(text == "", "").otherwise(F.concat(F.lit("?"), text))


def _digits(phone: Column) -> Column:
    return F.regexp_replace(js_trim(phone), rf"[().-]|{WS}", "")


def _wifi(v: Column) -> Column:
    return F.regexp_replace(v, r'([\;,:"])', r"\\$1")


def _card(v: Column) -> Column:
    v = F.replace(js_trim(v), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(v, r"\r?\n", r"\\n"), "([;,])", r"\\$1")


def contact_payloads(df: DataFrame) -> DataFrame:
    """Add ``errors`` (MAP field -> reason) and ``payload`` (NULL when rejected) to contact rows."""
    c = {f: F.coalesce(F.col(f), F.lit("")) if f != "wifi_hidden" else F.coalesce(F.col(f), F.lit(False))
         for f in CONTACT_FIELDS}
    kind = F.col("kind")
    bad_email = lambda v: ~js_trim(v).rlike(EMAIL)
    bad_phone = lambda v: ~js_trim(v).rlike(PHONE)
    bad_site = lambda v: website_url(v).isNull()
    need = lambda k, f, test, reason: F.when((kind == k) & test, F.struct(F.lit(f).alias("f"), F.lit(reason).alias("r")))
    checks = [
        need("text", "text", is_blank(c["text"]), "required"),
        need("url", "url", is_blank(c["url"]), "required"),
        need("url", "url", ~is_blank(c["url"]) & bad_site(c["url"]), "invalid"),
        need("email", "email", is_blank(c["email"]), "required"),
        need("email", "email", ~is_blank(c["email"]) & bad_email(c["email"]), "invalid"),
        need("phone", "phone", is_blank(c["phone"]), "required"),
        need("phone", "phone", ~is_blank(c["phone"]) & bad_phone(c["phone"]), "invalid"),
        need("sms", "sms_phone", is_blank(c["sms_phone"]), "required"),
        need("sms", "sms_phone", ~is_blank(c["sms_phone"]) & bad_phone(c["sms_phone"]), "invalid"),
        need("wifi", "wifi_ssid", is_blank(c["wifi_ssid"]), "required"),
        need("wifi", "wifi_password", (c["wifi_security"] != "nopass") & (c["wifi_password"] == ""), "required"),
        need("vcard", "vcard_name", is_blank(c["vcard_name"]), "required"),
        need("vcard", "vcard_email", ~is_blank(c["vcard_email"]) & bad_email(c["vcard_email"]), "invalid"),
        need("vcard", "vcard_phone", ~is_blank(c["vcard_phone"]) & bad_phone(c["vcard_phone"]), "invalid"),
        need("vcard", "vcard_website", ~is_blank(c["vcard_website"]) & bad_site(c["vcard_website"]), "invalid"),
    ]
    errors = F.map_from_entries(F.filter(F.array(*checks), lambda x: x.isNotNull()))
    line = lambda prefix, v, shown: F.when(~is_blank(v), F.concat(F.lit(prefix), shown))
    card = F.array(
        F.lit("BEGIN:VCARD"), F.lit("VERSION:3.0"), F.concat(F.lit("FN:"), _card(c["vcard_name"])),
        line("ORG:", c["vcard_organization"], _card(c["vcard_organization"])),
        line("TITLE:", c["vcard_title"], _card(c["vcard_title"])),
        line("TEL;TYPE=CELL:", c["vcard_phone"], _card(_digits(c["vcard_phone"]))),
        line("EMAIL:", c["vcard_email"], _card(c["vcard_email"])),
        line("URL:", c["vcard_website"], _card(website_url(c["vcard_website"]))),
        F.when(~is_blank(c["vcard_address"]), F.concat(F.lit("ADR;TYPE=HOME:;;"), _card(c["vcard_address"]), F.lit(";;;;"))),
        F.lit("END:VCARD"),
    )
    password = F.when(c["wifi_security"] == "nopass", "").otherwise(F.concat(F.lit("P:"), _wifi(c["wifi_password"]), F.lit(";")))
    payload = (
        F.when(kind == "text", c["text"]).when(kind == "url", website_url(c["url"]))
        .when(kind == "email", F.concat(F.lit("mailto:"), js_trim(c["email"]),
                                        _query(("subject", c["email_subject"]), ("body", c["email_body"]))))
        .when(kind == "phone", F.concat(F.lit("tel:"), _digits(c["phone"])))
        .when(kind == "sms", F.concat(F.lit("sms:"), _digits(c["sms_phone"]), _query(("body", c["sms_message"]))))
        .when(kind == "wifi", F.concat(F.lit("WIFI:T:"), c["wifi_security"], F.lit(";S:"), _wifi(c["wifi_ssid"]), F.lit(";"),
                                       password, F.lit("H:"), F.when(c["wifi_hidden"], "true").otherwise("false"), F.lit(";;")))
        .when(kind == "vcard", F.array_join(F.filter(card, lambda x: x.isNotNull()), "\r\n"))
    )
    d = df.withColumn("errors", errors)
    return d.withColumn("payload", F.when((F.size("errors") == 0) & (payload != ""), payload))


def contact_error_counts(processed: DataFrame) -> DataFrame:
    return (
        processed.select("kind", F.explode("errors").alias("field", "reason"))
        .groupBy("kind", "field", "reason").agg(F.count("*").alias("n"))
    )
