"""Strict record files, table export and collision-free export names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sheaf.functions import ordered
from sheaf.functions.numbers import plain_number
from sheaf.functions.text import WS, js_trim, normalize_text
from sheaf.session import stage

#: Stand for one that a cell holds, and for the border of two cells, while a record is taken apart.
MARK, BORDER = "\x01a", "\x01b"


def _physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, seq, sub, text, ends, valid): every physical line with the line break that ends it.

    Files are read in byte ranges; ``start`` is the first byte of a line's range and ``seq`` its order in it. Line feeds
    border the ranges, carriage returns split what lies between."""
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.make_valid_utf8("value").alias("value"), F.is_valid_utf8("value").alias("valid"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("seq"))
    raw = raw.withColumn("parts", F.split("value", "\r", -1))
    both = (F.element_at("parts", -1) == "") & (F.size("parts") > 1)
    count = F.size("parts") - F.when(both, 1).otherwise(0)
    parts = raw.select("file", "start", "seq", "valid", count.alias("count"), both.alias("both"), F.posexplode(F.slice("parts", F.lit(1), count)).alias("sub", "text"))
    last = F.col("sub") == F.col("count") - 1
    ends = F.when(~last, "\r").when(F.col("both"), "\r\n").otherwise("\n")
    return parts.select("file", "start", "seq", "sub", "text", ends.alias("ends"), "valid")


def _taken_apart(record: Column) -> tuple[Column, Column]:
    """The cells of a record, and whether its quotes follow the grammar.

    Cut at its quotes, every second piece of a record lies inside them. Of the others the empty ones between two quotes
    stand for a quote in a cell; else a quote opens a cell at its start and closes it at its end."""
    pieces = F.split(F.replace(record, F.lit("\x01"), F.lit(MARK)), '"', -1)
    last = F.size(pieces) - 1

    def fits(p: Column, i: Column) -> Column:
        opened = (i == last) | F.endswith(p, F.lit(",")) | ((i == 0) & (p == ""))
        closed = (i == 0) | F.startswith(p, F.lit(",")) | ((i == last) & (p == ""))
        return (i % 2 == 1) | ((p == "") & (i > 0) & (i < last)) | (opened & closed)

    def shown(p: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, p).when((p == "") & (i > 0) & (i < last), '"').otherwise(F.replace(p, F.lit(","), F.lit(BORDER)))

    cells = F.split(F.array_join(F.transform(pieces, shown), ""), BORDER, -1)
    cells = F.transform(cells, lambda c: F.replace(c, F.lit(MARK), F.lit("\x01")))
    return cells, (last % 2 == 0) & F.forall(F.transform(pieces, fits), lambda x: x)


def read_records(spark: SparkSession, path: str, key_column: str) -> tuple[DataFrame, DataFrame]:
    """(records, violations) of quoted comma files, all cells text, each file under its own header.

    records: file, record_no, physical_row (start line in the file), key, norm_key, cells MAP; those that keep the
    grammar and have as many cells as their header. violations: file, physical_row, reason (encoding, malformed-quote,
    unterminated-quote, width, blank-key, duplicate-key; and of whole files, which give no records: header, key-column,
    no-records). A blank line is a record of one empty cell. A byte order mark is skipped; a record with bytes that are
    no UTF-8 shows them as U+FFFD.

    One file is read by as many tasks as it has byte ranges: whether a line starts inside quotes follows from the number
    of quotes before it, a running sum over ranges. The lines of a record meet in one task; those after an unterminated
    quote don't. A file whose only line breaks are carriage returns is one range; files of no bytes are not seen."""
    lines = stage(_physical_lines(spark, path))
    quotes = (F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))).cast("bigint")
    lines = lines.withColumn("own", quotes)
    order = {"keys": ["file"], "order": ["seq", "sub"], "block": F.col("start")}
    lines = stage(ordered.running(lines, sums={"quotes": F.col("own"), "line": F.lit(1).cast("bigint")}, inclusive=False, **order))
    opens = F.col("quotes") % 2 == 0
    lines = stage(ordered.running(lines, sums={"record": F.when(opens, 1).otherwise(0).cast("bigint")}, **order))
    text = F.when(F.col("line") == 0, F.regexp_replace("text", "^\ufeff", "")).otherwise(F.col("text"))
    unended = lines.groupBy("file").agg((F.sum("own") % 2 == 1).alias("unended"), F.max("record").alias("record")).where("unended")
    lines = lines.withColumn("text", text).join(unended, ["file", "record"], "left").where(F.col("unended").isNull() | opens)
    joined = lines.groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("line", "text", "ends"))).alias("parts"), F.min("line").alias("first"), F.bool_and("valid").alias("valid"),
        F.max("unended").alias("unended"))
    body = F.transform("parts", lambda p, i: F.when(i == F.size("parts") - 1, p["text"]).otherwise(F.concat(p["text"], p["ends"])))
    joined = joined.withColumn("text", F.array_join(body, ""))
    # what is cut off from an unterminated record closes for this look at its quotes
    looked = F.when(F.col("unended"), F.concat("text", F.lit('"'))).otherwise(F.col("text"))
    cells, fits = _taken_apart(looked)
    d = stage(joined.select("file", (F.col("record") - 1).alias("record_no"), (F.col("first") + 1).alias("physical_row"), "valid",
                            F.coalesce("unended", F.lit(False)).alias("unended"), cells.alias("values"), fits.alias("fits")))
    heads = _headers(d, spark.read.format("binaryFile").load(path).select(F.col("path").alias("file")), key_column)
    d = d.where("record_no > 0").join(heads.where("reason IS NULL").drop("reason"), "file")
    # keys are looked at in records that keep the grammar
    fault = (F.when(~F.col("fits"), "malformed-quote").when(F.col("unended"), "unterminated-quote")
             .when(F.size("values") != F.size("headers"), "width"))
    d = stage(d.withColumn("fault", fault))
    sound = d.where("fault IS NULL").withColumn("key", F.element_at("values", (F.col("at") + 1).cast("int"))).select(
        "file", "record_no", "physical_row", "key", normalize_text("key").alias("norm_key"), F.map_from_arrays("headers", "values").alias("cells"))
    repeated = sound.groupBy("norm_key").agg(F.count("*").alias("n")).filter("n > 1")
    where = ["file", "physical_row"]
    named = lambda rows, reason: rows.select(*where, F.lit(reason).alias("reason"))
    violations = (
        d.where("fault IS NOT NULL").select(*where, F.col("fault").alias("reason"))
        .unionByName(named(d.where("NOT valid"), "encoding"))
        .unionByName(named(sound.filter("norm_key = ''"), "blank-key"))
        .unionByName(named(sound.filter("norm_key <> ''").join(repeated, "norm_key", "left_semi"), "duplicate-key"))
        .unionByName(heads.where("reason IS NOT NULL").select("file", F.lit(1).cast("bigint").alias("physical_row"), "reason")))
    return sound, violations


def _headers(d: DataFrame, files: DataFrame, key_column: str) -> DataFrame:
    """(file, headers, at, reason): the header of every file, the place of its key column, and what makes the file unusable."""
    folded = F.transform("headers", lambda h: normalize_text(h))
    first = d.where("record_no = 0").select(
        F.col("file").alias("f"), F.col("values").alias("headers"), (F.col("fits") & ~F.col("unended") & F.col("valid")).alias("fine"))
    some = d.where("record_no > 0").select(F.col("file").alias("f")).distinct().withColumn("some", F.lit(True))
    same = lambda path: F.regexp_replace(path, "^file:/+", "file:/")  # the two readers write local paths with one or three slashes
    heads = files.join(first.join(some, "f", "left"), same(F.col("file")) == same(F.col("f")), "left").withColumn("file", F.coalesce("f", "file"))
    at = F.array_position("headers", key_column) - 1
    reason = (F.when(F.col("some").isNull(), "no-records")
              .when(~F.col("fine") | F.exists(folded, lambda h: h == "") | (F.size(F.array_distinct(folded)) < F.size("headers")), "header")
              .when(at < 0, "key-column"))
    return heads.select("file", "headers", at.alias("at"), reason.alias("reason"))


def csv_lines(typed: DataFrame) -> DataFrame:
    """(table_id, row, line): cells of a row quoted only where needed."""
    value = F.coalesce(plain_number("num"), F.col("text")) if "num" in typed.columns else F.col("text")
    quoted = F.when(value.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)
    member = F.array_sort(F.collect_list(F.struct("col", quoted.alias("v"))))
    return typed.groupBy("table_id", "row").agg(F.array_join(F.transform(member, lambda m: m["v"]), ",").alias("line"))


def write_table_csv(typed: DataFrame, path: str) -> None:
    """One folder of ordered part files per table, CRLF lines, byte order mark on the first line.

    Range partitioning on (table, row) spreads one huge table over many files in row order."""
    lines = csv_lines(typed).withColumn("value", F.when(F.col("row") == 0, F.concat(F.lit("﻿"), "line")).otherwise(F.col("line")))
    ordered_lines = lines.repartitionByRange("table_id", "row").sortWithinPartitions("table_id", "row")
    ordered_lines.select("table_id", "value").write.partitionBy("table_id").option("lineSep", "\r\n").text(path)


def safe_base_name(name: Column, fallback: str, extension: str = r"(?i)\.pdf$") -> Column:
    base = F.regexp_replace(F.regexp_replace(name, extension, ""), r'[<>:"/\\|?*\x00-\x1f]', "-")
    base = js_trim(F.regexp_replace(F.regexp_replace(base, WS + "+", " "), rf"(?:[.-]|{WS})+\z", ""))
    return F.when(base == "", fallback).otherwise(base)


def sheet_base(name: Column) -> Column:
    base = js_trim(F.regexp_replace(F.regexp_replace(name, r"[\\/*?:\[\]]", " "), WS + "+", " "))
    return F.left(F.when(base == "", "Table").otherwise(base), F.lit(31))


def unique_export_names(df: DataFrame, job: str, ordinal: str, name: str) -> DataFrame:
    """df + ``export_name``, unique per job without case: in order, the first free of ``base``, ``base 2``, ….

    Each base first numbers its own rows, which is final unless a name such as ``X 2`` comes in literally.
    Then the earliest row of a family that meets an earlier row skips that number, round by round: all
    rows before it are settled, so the result is that of one ordered walk. Names can only meet inside a
    family (the text before its first number, up to the part no suffix can cut off)."""
    d = df.withColumn("u_base", sheet_base(F.col(name))).withColumn("u_low", F.lower("u_base"))
    d = ordered.row_numbers(d, [job, "u_low"], [ordinal], "u_rank")
    d = stage(d.select(*df.columns, "u_base", "u_low", "u_rank"))
    skipped = None

    def named(rows: DataFrame) -> DataFrame:
        tail = F.when(F.col("u_k") == 1, "").otherwise(F.concat(F.lit(" "), F.col("u_k").cast("string")))
        cut = F.left("u_base", (F.lit(31) - F.length(tail)).cast("int"))
        return rows.withColumn("u_name", F.concat(cut, tail)).withColumn("u_lname", F.lower("u_name"))

    while True:
        if skipped is None:
            n = named(d.withColumn("u_k", F.col("u_rank")))
        else:
            gaps = skipped.groupBy(job, "u_low").agg(F.array_sort(F.collect_set("u_k")).alias("u_gaps"))
            j = d.join(gaps, [job, "u_low"], "left")
            # Each skipped number at or below the running number pushes it up by one.
            k = F.aggregate(F.coalesce("u_gaps", F.array().cast("array<bigint>")), F.col("u_rank"),
                            lambda a, g: F.when(g <= a, a + 1).otherwise(a))
            n = named(j.withColumn("u_k", k)).drop("u_gaps")
        n = stage(n)
        first = n.groupBy(job, "u_lname").agg(F.min(ordinal).alias("u_first"), F.count("*").alias("u_n")).filter("u_n > 1")
        met = n.join(first, [job, "u_lname"]).filter(F.col(ordinal) > F.col("u_first"))
        family = F.left(F.regexp_replace("u_low", r" \d.*$", ""), F.lit(19))
        clash = met.groupBy(job, family.alias("u_family")).agg(F.min_by(F.struct("u_low", "u_k"), ordinal).alias("c"))
        clash = stage(clash.select(job, "c.*"))
        if clash.isEmpty():
            return n.select(*df.columns, F.col("u_name").alias("export_name"))
        skipped = clash if skipped is None else skipped.unionByName(clash)
