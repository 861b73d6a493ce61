"""Text, JSON, streaming and record-calculator queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from sheaf.fixtures import ctes, load
from sheaf.functions.text import WHITESPACE
from sheaf.operators import jsonops as j, records as rec, textops as t
from sheaf.session import shared_folder
from sheaf.streaming import jobs


def _stats(spark, sf):
    return t.text_stats(load(spark, sf, "documents"), "text", ["doc_id"])


def _cases(spark, sf):
    part = load(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("t"))
    said = load(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.col("text").alias("t"))
    d = part.withColumn("src", F.lit("part")).unionByName(said.withColumn("src", F.lit("said")))
    return d.select("src", "k", *[t.convert_case("t", s).alias(s) for s in t.CASE_STYLES])


def _clean(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(t.clean_text("text")).alias("cleaned"))


def _processed(spark, sf):
    return j.json_process(load(spark, sf, "fx_json"), "body")


def _json(spark, sf):
    return _processed(spark, sf).select(
        "event_id", "ok", F.coalesce("root_type", F.lit("none")).alias("root_type"), F.coalesce("output", F.lit("")).alias("output")
    )


def _json_errors(spark, sf):
    _, bad = j.quarantine(_processed(spark, sf))
    return bad.select("event_id", F.coalesce("position", F.lit(-1)).alias("position"), F.coalesce("line", F.lit(-1)).alias("line"),
                      F.coalesce("column", F.lit(-1)).alias("column"))


def _events_latest(df):
    return df.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type", "value", "props")


def _latest(spark, sf):
    return _events_latest(j.latest_response(load(spark, sf, "events"), "user_id", ["ts", "event_id"]))


def _stream(spark, sf, name):
    schema = load(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _folder(spark, name):
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _st1(spark, sf):
    base = _folder(spark, "quarantine")
    events = _stream(spark, sf, "events").withColumn(
        "body", F.when(F.col("event_id") % 10 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props")))
    jobs.stream_json_quarantine(events, "body", base + "/good", base + "/bad", base + "/state").awaitTermination()
    side = lambda p, ok: spark.read.parquet(base + p).select("event_id", F.lit(ok).alias("ok"), "body")
    return side("/good", True).unionByName(side("/bad", False))


def _st2(spark, sf):
    base = _folder(spark, "latest")
    latest = jobs.stream_latest(_stream(spark, sf, "events"), "user_id", ["ts", "event_id"])
    # A trigger writes the keys it changed; readers take the newest row of each.
    (latest.writeStream.outputMode("update").option("checkpointLocation", base + "/state").trigger(availableNow=True)
     .foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{base}/out/batch={i}")).start().awaitTermination())
    return _events_latest(j.latest_response(spark.read.parquet(base + "/out").drop("batch"), "user_id", ["ts", "event_id"]))


def _change(spark, sf):
    o = load(spark, sf, "orders")
    period = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("period")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    m = o.groupBy(F.col("o_orderstatus").alias("status"), period).agg((F.sum(cents)).cast("double").alias("cents"))
    return rec.period_change(m, "cents", "period", ["status"]).select(
        "status", "period", F.coalesce(F.round("percent", 6), F.lit(-1e9)).alias("percent"), "direction")


def _share(spark, sf):
    o = load(spark, sf, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    d = rec.share_of_whole(o, "cents", ["o_orderstatus"], ["o_orderpriority"])
    return d.select("o_orderpriority", "o_orderstatus", "part", "whole", F.round("percent", 6).alias("percent"))


def _units(spark, sf):
    d = rec.normalize_units(load(spark, sf, "fx_measurements"), "value", "unit", "target", "category")
    return d.groupBy("category", "unit", "target").agg(
        F.count("*").alias("n"), F.count("converted").alias("known"), F.min("converted").alias("low"), F.max("converted").alias("high"))


def _units_display(spark, sf):
    d = rec.normalize_units(load(spark, sf, "fx_measurements"), "value", "unit", "target", "category")
    d = d.withColumn("shown", rec.display_number(F.col("converted")))
    return d.groupBy("unit", "shown").agg(F.count("*").alias("n"))


def _ages(spark, sf):
    cols = ["years", "months", "days", "total_days", "total_weeks", "total_months", "days_to_next"]
    d = rec.age_breakdown(load(spark, sf, "fx_tenures"), "start_date", "as_of")
    return d.select("o_orderkey", *[F.coalesce(c, F.lit(-1)).alias(c) for c in cols], "valid")


def _contacts(spark, sf):
    d = rec.contact_payloads(load(spark, sf, "fx_contacts"))
    errors = F.array_join(F.array_sort(F.transform(F.map_entries("errors"), lambda e: F.concat_ws(":", e["key"], e["value"]))), ",")
    return d.select("k", "kind", errors.alias("errors"), F.coalesce("payload", F.lit("")).alias("payload"))


QUERIES = {
    "x1_text_stats": _stats,
    "x1_corpus_rollup": lambda s, sf: t.corpus_rollup(load(s, sf, "documents"), "text", ["lang", "source"]),
    "x2_ocr_text_metrics": lambda s, sf: t.ocr_text_metrics(load(s, sf, "conversations"), "text", ["conv_id", "role"]),
    "x3_keywords": lambda s, sf: t.keywords(load(s, sf, "documents"), "text", "doc_id"),
    "x3_corpus_keywords": lambda s, sf: t.corpus_keywords(load(s, sf, "documents"), "text", "doc_id"),
    "x4_convert_case": _cases,
    "x4_name_collisions": lambda s, sf: t.name_collisions(
        load(s, sf, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.initcap("p_name")).otherwise(F.col("p_name")).alias("n")), "n"),
    "x5_clean_text": _clean,
    "x5_cleaning_report": lambda s, sf: t.cleaning_report(load(s, sf, "documents"), "text", ["lang"]),
    "x6_json_process": _json,
    "x6_json_rejects": _json_errors,
    "x7_json_profile": lambda s, sf: j.json_profile(_processed(s, sf), ["event_type"]),
    "x8_latest_response": _latest,
    "st1_stream_json_quarantine": _st1,
    "st2_stream_latest": _st2,
    "c1_period_change": _change,
    "c2_share_of_whole": _share,
    "c3_normalize_units": _units,
    "c3_unit_display": _units_display,
    "c4_age_breakdown": _ages,
    "c5_contact_payloads": _contacts,
    "c5_contact_errors": lambda s, sf: rec.contact_error_counts(rec.contact_payloads(load(s, sf, "fx_contacts"))),
}

_WS = r"[\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_CHARS = "||".join(f"chr({ord(c)})" for c in WHITESPACE)
_NL = r"replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10))"
_BLANKLESS = lambda parts: f"len(list_filter({parts}, lambda x: length(trim(x, w)) > 0))"
_STATS = f"""(SELECT *, ceil(words / 200) AS reading_minutes, ceil(words / 130) AS speaking_minutes FROM (
    SELECT d.*, length(n) AS characters, length(regexp_replace(n, '{_WS}+', '', 'g')) AS characters_no_spaces,
      len(regexp_extract_all(n, '[\\p{{L}}\\p{{N}}_-]+')) AS words,
      {_BLANKLESS(f"string_split(regexp_replace(trim(n, w), '[.!?]+({_WS}|$)', chr(1) || '\\1', 'g'), chr(1))")} AS sentences,
      {_BLANKLESS(f"regexp_split_to_array(n, '\\n{_WS}*\\n')")} AS paragraphs,
      CASE WHEN n = '' THEN 0 ELSE len(string_split(n, chr(10))) END AS lines
    FROM (SELECT *, {_NL} AS n, {_CHARS} AS w FROM documents) d))"""
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in t.STOP_WORDS)
_WORDS = f"""words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM
      (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_-]+') AS ws FROM documents)),
    valid AS (SELECT * FROM words WHERE length(word) > 2 AND NOT regexp_full_match(word, '[0-9]+') AND word NOT IN ({_STOP}))"""
_SPLIT = r"""string_split(trim(regexp_replace(regexp_replace(regexp_replace(t, '([a-z])([A-Z])', '\1 \2', 'g'),
    '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[^a-zA-Z0-9]+', ' ', 'g')), ' ')"""
_CAP = "upper(left(x, 1)) || lower(substr(x, 2))"
_CLEAN = f"""list_aggregate(list_filter(list_transform(string_split({_NL}, chr(10)),
    lambda x: regexp_replace(trim(x, {_CHARS}), '[ \\t]+', ' ', 'g')), lambda x: length(trim(x, {_CHARS})) > 0), 'string_agg', chr(10))"""
_ROOT = "CASE event_id % 10 WHEN 1 THEN 'array' WHEN 2 THEN 'number' WHEN 3 THEN 'null' ELSE 'object' END"
_UNITS = "(VALUES " + ", ".join(
    f"('{c}', '{u}', {f!r}::DOUBLE)" for c, m in (("length", rec.LENGTH), ("weight", rec.WEIGHT)) for u, f in m.items()
) + ")"
_CONVERTED = f"""(SELECT m.*, CASE WHEN m.category <> 'temperature' THEN value * a.f / b.f
      WHEN m.unit = 'f' THEN (value - 32) * 5 / 9 ELSE value - 273.15::DOUBLE END AS converted
    FROM fx_measurements m LEFT JOIN {_UNITS} a(c, u, f) ON a.c = m.category AND a.u = m.unit
    LEFT JOIN {_UNITS} b(c, u, f) ON b.c = m.category AND b.u = m.target)"""
_LATEST = """SELECT user_id, event_id, epoch_us(ts) AS at, event_type, value, props FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"""
_ENC = "replace(replace(url_encode({}), '+', '%20'), '%28', '(')"
_CONTACT_ERRORS = r"""SELECT *, concat_ws(',',
   CASE WHEN kind = 'email' AND NOT regexp_matches(email, '@') THEN 'email:invalid' END,
   CASE WHEN kind = 'phone' AND k % 6 = 0 THEN 'phone:invalid' END,
   CASE WHEN kind = 'sms' AND sms_phone = '' THEN 'sms_phone:required' END,
   CASE WHEN kind = 'text' AND trim(text) = '' THEN 'text:required' END,
   CASE WHEN kind = 'url' AND starts_with(url, 'ftp') THEN 'url:invalid' END,
   CASE WHEN kind = 'vcard' AND vcard_email = 'bad@mail' THEN 'vcard_email:invalid' END,
   CASE WHEN kind = 'vcard' AND vcard_name = '' THEN 'vcard_name:required' END,
   CASE WHEN kind = 'wifi' AND wifi_security <> 'nopass' AND wifi_password = '' THEN 'wifi_password:required' END,
   CASE WHEN kind = 'wifi' AND trim(wifi_ssid) = '' THEN 'wifi_ssid:required' END) AS errors FROM fx_contacts"""

ORACLES = {
    "x1_text_stats": f"""SELECT doc_id, characters, characters_no_spaces, words, sentences, paragraphs, lines,
        cast(reading_minutes AS bigint) AS reading_minutes, cast(speaking_minutes AS bigint) AS speaking_minutes FROM {_STATS}""",
    "x1_corpus_rollup": f"""SELECT lang, source, count(*) AS texts, cast(sum(characters) AS bigint) AS characters, cast(sum(words) AS bigint) AS words,
        cast(sum(sentences) AS bigint) AS sentences, cast(sum(paragraphs) AS bigint) AS paragraphs, max(words) AS max_words,
        quantile_disc(words, 0.5) AS median_words FROM {_STATS} GROUP BY ALL""",
    "x2_ocr_text_metrics": f"""SELECT conv_id, role, count(*) AS texts, cast(sum(length(t)) AS bigint) AS characters,
        cast(sum(len(regexp_extract_all(t, '[^' || '{_WS[1:-1]}' || ']+'))) AS bigint) AS words FROM (
        SELECT conv_id, role, coalesce(list_aggregate(list_filter(list_transform(regexp_split_to_array({_NL}, '\\n{_WS}*\\n'), lambda p:
          coalesce(list_aggregate(list_filter(list_transform(string_split(p, chr(10)), lambda x: trim(regexp_replace(x, '[\\t ]+', ' ', 'g'), {_CHARS})),
          lambda x: x <> ''), 'string_agg', chr(10)), '')), lambda p: p <> ''), 'string_agg', chr(10) || chr(10)), '') AS t FROM conversations) GROUP BY ALL""",
    "x3_keywords": f"""WITH {_WORDS}, c AS (SELECT doc_id, word, count(*) AS "count", min(pos) AS p FROM valid GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "count" DESC, p) AS rank, sum("count") OVER (PARTITION BY doc_id) AS total FROM c)
        SELECT doc_id, cast(rank AS int) AS rank, word, "count", floor("count" / total * 1000 + 0.5) / 10 AS percentage FROM r WHERE rank <= 8""",
    "x3_corpus_keywords": f"""WITH {_WORDS}, c AS (SELECT word, count(*) AS "count", min(doc_id * 1000000 + pos) AS p FROM valid GROUP BY ALL)
        SELECT word, "count", floor("count" / (SELECT sum("count") FROM c) * 1000 + 0.5) / 10 AS percentage FROM c ORDER BY "count" DESC, p LIMIT 8""",
    "x4_convert_case": f"""WITH s AS (SELECT 'part' AS src, p_partkey AS k, concat_ws(' ', p_name, p_type, p_brand) AS t FROM part
          UNION ALL SELECT 'said', conv_id * 1000 + turn, text FROM conversations)
        SELECT src, k, upper(replace(t, 'ß', 'SS')) AS upper, lower(t) AS lower,
          list_aggregate(list_transform(regexp_extract_all(t, '[a-zA-Z0-9_][^{_WS[1:-1]}]*|[^a-zA-Z0-9_]+'),
            lambda x: CASE WHEN regexp_matches(x, '^[a-zA-Z0-9_]') THEN {_CAP} ELSE x END), 'string_agg', '') AS title,
          list_aggregate(list_transform(regexp_extract_all(lower(t), '^{_WS}*[a-zA-Z0-9_]|[.!?]{_WS}+[a-zA-Z0-9_]|[^.!?]+|[.!?]'),
            lambda x, i: CASE WHEN (i = 1 AND regexp_full_match(x, '{_WS}*[a-zA-Z0-9_]')) OR regexp_full_match(x, '[.!?]{_WS}+[a-zA-Z0-9_]') THEN upper(x) ELSE x END), 'string_agg', '') AS sentence,
          list_aggregate(list_transform({_SPLIT}, lambda x, i: CASE WHEN i = 1 THEN lower(x) ELSE {_CAP} END), 'string_agg', '') AS camel,
          lower(list_aggregate({_SPLIT}, 'string_agg', '-')) AS kebab, lower(list_aggregate({_SPLIT}, 'string_agg', '_')) AS snake,
          upper(list_aggregate({_SPLIT}, 'string_agg', '_')) AS "constant" FROM s""",
    "x4_name_collisions": """SELECT replace(lower(p_name), ' ', '_') AS folded, count(DISTINCT p_partkey % 2 = 0) AS raw_names, count(*) AS rows
        FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey % 2 = 0) > 1""",
    "x5_clean_text": f"SELECT doc_id, md5(coalesce({_CLEAN}, '')) AS cleaned FROM documents",
    "x5_cleaning_report": f"""SELECT lang, count(*) AS texts, count_if(text <> c) AS changed, cast(sum(strlen(text)) AS bigint) AS bytes_before,
        cast(sum(strlen(c)) AS bigint) AS bytes_after FROM (SELECT lang, text, coalesce({_CLEAN}, '') AS c FROM documents) GROUP BY lang""",
    "x6_json_process": f"""WITH {ctes('fx_json')} SELECT event_id, event_id % 10 NOT IN (0, 5) AS ok,
        CASE WHEN event_id % 10 IN (0, 5) THEN 'none' ELSE {_ROOT} END AS root_type,
        CASE WHEN event_id % 10 IN (0, 5) THEN '' WHEN event_id % 10 = 6 THEN '{{"k":2,"b":"x"}}'
             ELSE cast(json(ltrim(body, '\ufeff')) AS varchar) END AS output FROM fx_json""",
    "x6_json_rejects": f"""WITH {ctes('fx_json')} SELECT event_id, CASE WHEN event_id % 10 = 5 THEN -1 ELSE length(body) END AS position,
        CASE WHEN event_id % 10 = 5 THEN -1 ELSE 1 END AS line, CASE WHEN event_id % 10 = 5 THEN -1 ELSE length(body) + 1 END AS "column"
        FROM fx_json WHERE event_id % 10 IN (0, 5)""",
    "x7_json_profile": f"""SELECT event_type, event_id % 10 NOT IN (0, 5) AS ok,
        CASE WHEN event_id % 10 IN (0, 5) THEN 'none' ELSE {_ROOT} END AS root_type, count(*) AS n FROM events GROUP BY ALL""",
    "x8_latest_response": _LATEST,
    "st1_stream_json_quarantine": """SELECT event_id, event_id % 10 <> 0 AS ok,
        CASE WHEN event_id % 10 = 0 THEN left(props, length(props) - 1) ELSE props END AS body FROM events""",
    "st2_stream_latest": _LATEST,
    "c1_period_change": """WITH m AS (SELECT o_orderstatus AS status, cast(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS int) AS period,
          cast(sum(cast(round(o_totalprice * 100) AS bigint)) AS double) AS cents FROM orders GROUP BY ALL),
        p AS (SELECT *, lag(cents) OVER (PARTITION BY status ORDER BY period) AS b FROM m)
        SELECT status, period, coalesce(round((cents - b) / b * 100, 6), -1e9) AS percent,
          CASE WHEN b IS NULL THEN 'first' WHEN cents > b THEN 'increase' WHEN cents < b THEN 'decrease' ELSE 'no-change' END AS direction FROM p""",
    "c2_share_of_whole": """WITH g AS (SELECT o_orderpriority, o_orderstatus, cast(sum(cast(round(o_totalprice * 100) AS bigint)) AS bigint) AS part FROM orders GROUP BY ALL)
        SELECT *, cast(sum(part) OVER (PARTITION BY o_orderpriority) AS bigint) AS whole,
          round(part / cast(sum(part) OVER (PARTITION BY o_orderpriority) AS bigint) * 100, 6) AS percent FROM g""",
    "c3_normalize_units": f"""WITH {ctes('fx_measurements')} SELECT category, unit, target, count(*) AS n, count(converted) AS known,
        min(converted) AS low, max(converted) AS high FROM {_CONVERTED} GROUP BY ALL""",
    "c3_unit_display": f"""WITH {ctes('fx_measurements')} SELECT unit, CASE WHEN converted IS NULL THEN '—' ELSE
          CASE WHEN s IN ('0', '-0') THEN '0' ELSE s END END AS shown, count(*) AS n FROM (SELECT *, regexp_replace(regexp_replace(
          CASE WHEN abs(converted) >= 1000 THEN printf('%.2f', converted) WHEN abs(converted) >= 100 THEN printf('%.3f', converted)
          WHEN abs(converted) >= 1 THEN printf('%.4f', converted) WHEN abs(converted) >= 0.01 THEN printf('%.6f', converted)
          ELSE printf('%.9f', converted) END, '0+$', ''), '\\.$', '') AS s FROM {_CONVERTED}) GROUP BY ALL""",
    "c4_age_breakdown": f"""WITH {ctes('fx_tenures')}, a AS (SELECT *, start_date s, as_of e, start_date <= as_of AS valid FROM fx_tenures),
        b AS (SELECT *, CASE WHEN month(s) = 2 AND day(s) = 29 AND day(last_day(make_date(year(e), 2, 1))) = 28 THEN 28 ELSE day(s) END AS sd,
          make_date(year(e), month(s), CASE WHEN month(s) = 2 AND day(s) = 29 AND day(last_day(make_date(year(e), 2, 1))) = 28 THEN 28 ELSE day(s) END) AS this,
          make_date(year(e) + 1, month(s), CASE WHEN month(s) = 2 AND day(s) = 29 AND day(last_day(make_date(year(e) + 1, 2, 1))) = 28 THEN 28 ELSE day(s) END) AS nxt FROM a),
        c AS (SELECT *, (year(e) * 12 + month(e)) - (year(s) * 12 + month(s)) - CASE WHEN day(e) < sd THEN 1 ELSE 0 END AS tm,
          day(e) - sd + CASE WHEN day(e) < sd THEN day(date_trunc('month', e)::DATE - 1) ELSE 0 END AS dd FROM b)
        SELECT o_orderkey, cast(CASE WHEN valid THEN tm // 12 ELSE -1 END AS int) AS years, cast(CASE WHEN valid THEN tm % 12 ELSE -1 END AS int) AS months,
          cast(CASE WHEN valid THEN dd ELSE -1 END AS int) AS days, cast(CASE WHEN valid THEN e - s ELSE -1 END AS int) AS total_days,
          cast(CASE WHEN valid THEN (e - s) // 7 ELSE -1 END AS int) AS total_weeks, cast(CASE WHEN valid THEN tm ELSE -1 END AS int) AS total_months,
          cast(CASE WHEN valid THEN (CASE WHEN this <= e THEN nxt ELSE this END) - e ELSE -1 END AS int) AS days_to_next, valid FROM c""",
    "c5_contact_payloads": f"""WITH {ctes('fx_contacts')}, e AS ({_CONTACT_ERRORS}) SELECT k, kind, errors, CASE WHEN errors <> '' THEN '' ELSE
        CASE kind WHEN 'text' THEN text
          WHEN 'url' THEN CASE WHEN k % 4 = 0 THEN 'https://' || lower(url) || '/' ELSE 'http://a.example.com/p%20q?x=1' END
          WHEN 'email' THEN 'mailto:' || email || '?' || CASE WHEN email_subject <> '' THEN 'subject=Order%20no.%205%20%26%20more&' ELSE '' END || 'body=Line%20(1)'
          WHEN 'phone' THEN 'tel:+15550' || k
          WHEN 'sms' THEN 'sms:5550' || k || '?body=' || replace(name, '#', '%23')
          WHEN 'wifi' THEN 'WIFI:T:' || wifi_security || ';S:net\\;' || name || ';' || CASE WHEN wifi_security = 'nopass' THEN '' ELSE 'P:p\\:w' || k || ';' END
             || 'H:' || CASE WHEN wifi_hidden THEN 'true' ELSE 'false' END || ';;'
          ELSE concat_ws(chr(13) || chr(10), 'BEGIN:VCARD', 'VERSION:3.0', 'FN:' || name, 'ORG:Acme\\, Inc', 'TEL;TYPE=CELL:55501' || k,
             'EMAIL:v@mail.example.com', 'ADR;TYPE=HOME:;;1 Main St\\; B;;;;', 'END:VCARD') END END AS payload
        FROM e JOIN (SELECT c_custkey, c_name AS name FROM customer) ON c_custkey = k""",
    "c5_contact_errors": f"""WITH {ctes('fx_contacts')}, e AS ({_CONTACT_ERRORS}), x AS (SELECT kind, unnest(string_split(errors, ',')) AS er FROM e WHERE errors <> '')
        SELECT kind, split_part(er, ':', 1) AS field, split_part(er, ':', 2) AS reason, count(*) AS n FROM x GROUP BY ALL""",
}
