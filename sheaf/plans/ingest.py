"""Source, sink and extractor queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sheaf.fixtures import ctes, load
from sheaf.operators import tables as t
from sheaf.session import shared_folder
from sheaf.sources import extract, media, records


def _written_records(s, sf):
    """Customers as a quoted CSV file with line breaks, doubled quotes, blank and repeated keys."""
    k = F.col("c_custkey")
    rows = load(s, sf, "customer").select(
        F.when(k % 101 == 0, " ").when(k % 97 == 0, "same").otherwise(F.format_string("K%06d", k)).alias("ID"),
        F.when(k % 7 == 0, F.concat("c_name", F.lit(', "x"\nsecond'))).otherwise(F.col("c_name")).alias("Name"),
        F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("Balance"))
    path = f"{shared_folder(s)}/records-{uuid.uuid4().hex}"
    # Large tables come in splits without rows, and if the first is one, a plain writer leaves a file of a header alone there,
    # which is a violation. Under a partition column files are opened only for rows.
    rows.withColumn("batch", F.lit(0)).write.partitionBy("batch").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return records.read_records(s, path, "ID")


def _records(s, sf):
    d, _ = _written_records(s, sf)
    return d.select("norm_key", F.col("cells")["Name"].alias("name"), F.col("cells")["Balance"].alias("balance"))


def _line_budget(s, sf):
    """Start lines: per file the last start line and the line breaks inside cells must agree."""
    d, _ = _written_records(s, sf)
    inner = F.regexp_count(F.col("cells")["Name"], F.lit("\n"))
    g = d.groupBy("file").agg(F.count("*").alias("n"), F.max("physical_row").alias("last"), F.max_by(inner, "physical_row").alias("tail"), F.sum(inner).alias("inner"))
    return g.agg(F.sum("n").alias("records"), F.sum(F.col("last") + F.col("tail") - 1 - F.col("n") - F.col("inner")).alias("drift"))


def _csv(s, sf):
    headers = load(s, sf, "fx_statement_lines").select(F.col("k").alias("table_id")).distinct().withColumn("header_rows", F.lit(1))
    cells = load(s, sf, "fx_statements").withColumn("text", F.when(F.col("col") == 0, F.concat("text", F.lit(', "a"'))).otherwise(F.col("text")))
    return records.csv_lines(t.conservative_cast(cells, headers))


def _names(s, sf):
    p = load(s, sf, "part").withColumn("p_name", F.when(F.col("p_partkey") % 4 == 0, F.upper("p_name")).when(
        F.col("p_partkey") % 9 == 0, F.concat("p_name", F.lit(" / with a very long tail"))).otherwise(F.col("p_name")))
    return records.unique_export_names(p.select("p_brand", "p_partkey", "p_name"), "p_brand", "p_partkey", "p_name")


def _media(s, sf):
    """Tiny headers per part: PNG with the part's size, JPEG, WebP, PDF, wrong and empty files."""
    k, size = F.col("p_partkey"), F.col("p_size")
    four = lambda c: F.lpad(F.hex(c), 8, "0")
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC0001108"), F.lpad(F.hex(size * 2), 4, "0"), F.lpad(F.hex(size * 3), 4, "0"), F.lit("030111000000000000"))
    webp = F.concat(F.lit("5249464600000000574542505650385800000000"), F.lit("00000000"), F.lpad(F.hex(size), 2, "0"), F.lit("0000"), F.lpad(F.hex(size + 1), 2, "0"), F.lit("0000"))
    body = (
        F.when(k % 7 == 0, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), four(F.when(k % 5 == 0, size * 1000).otherwise(size * 10)), four(size * 5)))
        .when(k % 7 == 1, jpeg).when(k % 7 == 2, webp).when(k % 7 == 3, F.concat(F.repeat(F.lit("20"), (size * 30).cast("int")), F.lit("255044462D312E37")))
        .when(k % 7 == 4, F.lit("")).otherwise(F.lit("47494638")))
    ext = F.when(k % 7 == 0, "png").when(k % 7 == 1, F.when(k % 2 == 0, "jpg").otherwise("png")).when(k % 7 == 2, "webp").when(k % 7 == 3, "pdf").when(k % 7 == 4, "png").otherwise("gif")
    files = load(s, sf, "part").select(F.concat_ws(".", k.cast("string"), ext).alias("path"), F.unhex(body).alias("content"))
    return media.scan_media(files.withColumn("length", F.octet_length("content").cast("bigint")))


def _media_out(s, sf):
    none = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return _media(s, sf).select("path", "length", none("detected", ""), none("width", -1), none("height", -1), "reason")


def _files(s, sf):
    return load(s, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 0, ".txt").otherwise(".JSON")).alias("path"),
        F.when(F.col("doc_id") % 9 == 0, F.repeat("text", 40)).otherwise(F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 11 == 0, 30 * 1024 * 1024).otherwise(F.octet_length("text")).cast("bigint").alias("bytes"))


def _texts(s, sf, **limits):
    return media.admit_texts(_files(s, sf), **limits).select("path", F.coalesce(F.length("text"), F.lit(-1)).alias("kept"), "truncated", "reason")


def _lines_of(text):
    if len(text) % 13 == 0:
        raise ValueError("unreadable")
    for i, line in enumerate(text.split("\n")):
        yield {"line_no": i, "size": len(line)}


def _extracted(s, sf):
    extract.register_extractor("lines", _lines_of, "line_no int, size int")
    d = extract.extract(load(s, sf, "documents"), "lines", "doc_id", "text")
    return d.select("doc_id", F.coalesce("line_no", F.lit(-1)).alias("line_no"), F.coalesce("size", F.lit(-1)).alias("size"), "inspection_ok")


QUERIES = {
    "s1_read_records": _records,
    "s1_record_violations": lambda s, sf: _written_records(s, sf)[1].groupBy("reason").agg(F.count("*").alias("n")),
    "s1_physical_rows": _line_budget,
    "s2_csv_lines": _csv,
    "s3_unique_export_names": _names,
    "s4_scan_media": _media_out,
    "s4_media_audit": lambda s, sf: media.media_audit(_media(s, sf)),
    "s5_text_corpus": _texts,
    "s5_text_limits": lambda s, sf: _texts(s, sf, max_bytes=media.MAX_TEXT_BYTES, max_characters=media.MAX_TEXT_CHARACTERS),
    "s6_json_documents": lambda s, sf: media.admit_json(_files(s, sf))[0].select("path", "bytes"),
    "s6_json_rejects": lambda s, sf: media.admit_json(_files(s, sf), media.MAX_JSON_BYTES, media.MAX_JSON_CHARACTERS)[1],
    "k1_extract": _extracted,
}

_CUST = """c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 101 = 0 THEN '' WHEN c_custkey % 97 = 0 THEN 'same' ELSE printf('K%06d', c_custkey) END AS norm_key,
    CASE WHEN c_custkey % 7 = 0 THEN c_name || ', "x"' || chr(10) || 'second' ELSE c_name END AS name, cast(cast(c_acctbal AS decimal(18,2)) AS varchar) AS balance FROM customer)"""
_Q = lambda c: f"""CASE WHEN regexp_matches({c}, '[",]') THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END"""
_MEDIA = """m AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 7 AS t,
      p_partkey || '.' || CASE p_partkey % 7 WHEN 0 THEN 'png' WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'jpg' ELSE 'png' END WHEN 2 THEN 'webp' WHEN 3 THEN 'pdf' WHEN 4 THEN 'png' ELSE 'gif' END AS path FROM part),
    r AS (SELECT *, CASE t WHEN 0 THEN 24 WHEN 1 THEN 38 WHEN 2 THEN 30 WHEN 3 THEN s * 30 + 8 WHEN 4 THEN 0 ELSE 4 END AS length, CASE WHEN t = 3 AND s * 30 + 5 > 1024 THEN '' ELSE CASE t WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' WHEN 3 THEN 'pdf' ELSE '' END END AS detected,
      CASE t WHEN 0 THEN CASE WHEN k % 5 = 0 THEN s * 1000 ELSE s * 10 END WHEN 1 THEN s * 3 WHEN 2 THEN s + 1 ELSE -1 END AS width, CASE t WHEN 0 THEN s * 5 WHEN 1 THEN s * 2 WHEN 2 THEN s + 2 ELSE -1 END AS height FROM m),
    v AS (SELECT *, CASE WHEN t = 4 THEN 'empty-file' WHEN t > 4 THEN 'unsupported-type' WHEN detected = '' OR (t = 1 AND k % 2 = 1) THEN 'type-mismatch' WHEN width > 16384 OR width * height > 64000000 THEN 'dimensions-too-large' ELSE 'ok' END AS reason FROM r)"""
_FILES = """f AS (SELECT doc_id, 'd' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '.txt' ELSE '.JSON' END AS path, length(text) * CASE WHEN doc_id % 9 = 0 THEN 40 ELSE 1 END AS n, CASE WHEN doc_id % 11 = 0 THEN 31457280 ELSE strlen(text) END AS bytes FROM documents)"""

ORACLES = {
    "s1_read_records": f"WITH {_CUST} SELECT norm_key, name, balance FROM c",
    "s1_record_violations": f"WITH {_CUST}, d AS (SELECT norm_key, count(*) AS n FROM c WHERE norm_key <> '' GROUP BY 1 HAVING count(*) > 1) SELECT 'blank-key' AS reason, count(*) AS n FROM c WHERE norm_key = '' HAVING count(*) > 0 UNION ALL SELECT 'duplicate-key', sum(n)::BIGINT FROM d HAVING count(*) > 0",
    "s1_physical_rows": "SELECT count(*) AS records, 0::BIGINT AS drift FROM customer",
    "s2_csv_lines": f"""WITH {ctes('fx_statement_rows')}, z AS (SELECT table_id, row, a || ', "a"' AS a, b, CASE WHEN regexp_full_match(c, '[0-9.]+') THEN regexp_replace(regexp_replace(c, '0+$', ''), '\\.$', '') ELSE c END AS c FROM fx_statement_rows)
        SELECT table_id, row, {_Q('a')} || ',' || b || ',' || c AS line FROM z""",
    "s3_unique_export_names": """WITH n AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) WHEN p_partkey % 9 = 0 THEN p_name || ' / with a very long tail' ELSE p_name END AS p_name FROM part),
        b AS (SELECT *, left(trim(regexp_replace(replace(p_name, '/', ' '), ' +', ' ', 'g')), 31) AS base FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, lower(base) ORDER BY p_partkey) AS k FROM b)
        SELECT p_brand, p_partkey, p_name, CASE WHEN k = 1 THEN base ELSE left(base, cast(31 - length(' ' || k) AS bigint)) || ' ' || k END AS export_name FROM r""",
    "s4_scan_media": f"WITH {_MEDIA} SELECT path, cast(length AS bigint) AS length, detected, cast(CASE WHEN detected = '' THEN -1 ELSE width END AS bigint) AS width, cast(CASE WHEN detected = '' THEN -1 ELSE height END AS bigint) AS height, reason FROM v",
    "s4_media_audit": f"WITH {_MEDIA} SELECT reason, CASE WHEN detected = '' THEN 'none' ELSE detected END AS detected, count(*) AS files, cast(sum(length) AS bigint) AS bytes FROM v GROUP BY ALL",
    "s5_text_corpus": f"WITH {_FILES} SELECT path, cast(n AS int) AS kept, false AS truncated, 'ok' AS reason FROM f",
    "s5_text_limits": f"WITH {_FILES} SELECT path, cast(CASE WHEN bytes > 10485760 THEN -1 ELSE least(n, 500000) END AS int) AS kept, bytes <= 10485760 AND n > 500000 AS truncated, CASE WHEN bytes > 10485760 THEN 'file-too-large' ELSE 'ok' END AS reason FROM f",
    "s6_json_documents": f"WITH {_FILES} SELECT path, bytes FROM f WHERE doc_id % 4 <> 0",
    "s6_json_rejects": f"WITH {_FILES} SELECT path, bytes, CASE WHEN doc_id % 4 = 0 THEN 'wrong-extension' ELSE 'file-too-large' END AS reason FROM f WHERE doc_id % 4 = 0 OR bytes > 20971520",
    "k1_extract": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE length(text) % 13 <> 0)
        SELECT doc_id, cast(i AS int) AS line_no, cast(length(t) AS int) AS size, true AS inspection_ok FROM l UNION ALL SELECT doc_id, -1, -1, false FROM documents WHERE length(text) % 13 = 0""",
}
