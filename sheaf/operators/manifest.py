"""Page manifests: selections, ranges, splitting, editing, rotation and numbering.

``manifest(job_id, ordinal, page_id, source_id, page_index, rotation)``; ordinals are dense from 0.
Edits shift ordinals by arithmetic or by running counts, never by re-sorting a whole job in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sheaf.functions import ordered
from sheaf.functions.text import WS, js_trim

# Fixed limits.
MAX_JOB_PAGES = 500
MAX_TOTAL_BYTES = 100 * 1024 * 1024
_TOKEN = rf"^(\d+)(?:{WS}*-{WS}*(\d+))?\z"
_HUGE = 2**53


def _tokens(expr: Column) -> Column:
    return F.transform(F.split(js_trim(expr), ",", -1), js_trim)


def _range(token: Column) -> Column:
    number = lambda i: F.coalesce(F.regexp_extract(token, _TOKEN, i).try_cast("bigint"), F.lit(_HUGE))
    first = number(1)
    second = F.when(F.regexp_extract(token, _TOKEN, 2) == "", first).otherwise(number(2))
    return F.struct(F.least(first, second).alias("s"), F.greatest(first, second).alias("e"))


def _token_error(token: Column, r: Column, page_count: Column) -> Column:
    return (
        F.when(~token.rlike(_TOKEN) | (r["s"] < 1), "invalid-page-selection")
        .when(r["e"] > page_count, "page-out-of-range")
    )


def _parsed(df: DataFrame, expr: str, page_count: str) -> DataFrame:
    d = df.withColumn("__tok", _tokens(F.col(expr)))
    d = d.withColumn("__rng", F.transform("__tok", _range))
    errors = F.transform(F.arrays_zip("__tok", "__rng"), lambda z: _token_error(z["__tok"], z["__rng"], F.col(page_count)))
    empty = F.exists("__tok", lambda t: t == "")
    return d.withColumn("__empty", empty).withColumn("__err", errors)


def _first(errors: Column) -> Column:
    return F.try_element_at(F.filter(errors, lambda x: x.isNotNull()), F.lit(1))


def compact(pages: Column, separator: str = ",") -> Column:
    """1,2,3,7 to ``1-3,7`` for one sorted, distinct array."""
    apart = lambda p, i, step: F.coalesce(F.get(pages, i + step) != p + step, F.lit(True))
    starts = F.filter(pages, lambda p, i: apart(p, i, -1))
    ends = F.filter(pages, lambda p, i: apart(p, i, 1))
    label = lambda s, e: F.when(s == e, s.cast("string")).otherwise(F.concat_ws("-", s.cast("string"), e.cast("string")))
    return F.array_join(F.zip_with(starts, ends, label), separator)


def parse_selection(df: DataFrame, expr: str, page_count: str, max_pages: int | None = None) -> DataFrame:
    """Add error (NULL when valid), pages (sorted, distinct), n_pages and label.

    With ``max_pages``, larger selections are errors; else the document's pages are the only bound."""
    d = _parsed(df, expr, page_count)
    d = d.withColumn("__e", F.when(F.col("__empty"), "invalid-page-selection").otherwise(_first(F.col("__err"))))
    if max_pages is not None:  # one range beyond the limit is already too much, so it is never expanded
        wide = F.exists("__rng", lambda r: r["e"] - r["s"] + 1 > max_pages)
        d = d.withColumn("__e", F.coalesce("__e", F.when(wide, "workload-too-large")))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform("__rng", lambda r: F.sequence(r["s"], r["e"])))))
    d = d.withColumn("__p", F.when(F.col("__e").isNull(), pages))
    if max_pages is not None:
        d = d.withColumn("__e", F.coalesce("__e", F.when(F.size("__p") > max_pages, "workload-too-large")))
    valid = F.col("__e").isNull()
    label = compact(F.col("__p"), "-")
    return d.select(
        *df.columns, F.col("__e").alias("error"), F.when(valid, F.col("__p")).alias("pages"),
        F.when(valid, F.size("__p")).alias("n_pages"),
        F.when(valid, label).alias("label"),
    )


def _too_much(files: Column, pages: Column, max_files: int | None, max_pages: int | None) -> Column:
    """Why a job exceeds the limits given, NULL if it doesn't."""
    many = F.lit(None) if max_files is None else F.when(files > max_files, "too-many-output-files")
    return F.coalesce(many, F.lit(None) if max_pages is None else F.when(pages > max_pages, "workload-too-large")).cast("string")


def parse_ranges(df: DataFrame, expr: str, page_count: str, max_files: int | None = None, max_pages: int | None = None) -> DataFrame:
    """Add error and groups ARRAY<STRUCT<group_no, start, end, label>> in written order, no overlaps.

    Jobs over ``max_files`` groups or ``max_pages`` pages are errors if these are given."""
    d = _parsed(df, expr, page_count)
    zipped = F.arrays_zip("__err", "__rng")
    overlaps = lambda z, i: F.exists(
        F.slice("__rng", F.lit(1), i), lambda r: (r["s"] <= z["__rng"]["e"]) & (z["__rng"]["s"] <= r["e"]))
    codes = F.transform(zipped, lambda z, i: F.coalesce(z["__err"], F.when(overlaps(z, i), "overlapping-ranges")))
    total = F.aggregate("__rng", F.lit(0).cast("bigint"), lambda a, r: a + r["e"] - r["s"] + 1)
    error = (
        F.when(F.col("__empty"), "invalid-page-selection").when(_first(codes).isNotNull(), _first(codes))
        .otherwise(_too_much(F.size("__rng"), total, max_files, max_pages))
    )
    label = lambda r: F.when(r["s"] == r["e"], r["s"].cast("string")).otherwise(
        F.concat_ws("-", r["s"].cast("string"), r["e"].cast("string")))
    groups = F.transform("__rng", lambda r, i: F.struct(
        (i + 1).alias("group_no"), r["s"].alias("start"), r["e"].alias("end"), label(r).alias("label")))
    d = d.withColumn("__e", error)
    return d.select(*df.columns, F.col("__e").alias("error"), F.when(F.col("__e").isNull(), groups).alias("groups"))


def every_page_groups(df: DataFrame, page_count: str, max_files: int | None = None, max_pages: int | None = None) -> DataFrame:
    n = F.col(page_count)
    error = _too_much(n, n, max_files, max_pages)
    groups = F.transform(F.sequence(F.lit(1), n), lambda p: F.struct(
        p.alias("group_no"), p.cast("bigint").alias("start"), p.cast("bigint").alias("end"), p.cast("string").alias("label")))
    d = df.withColumn("error", error)
    return d.withColumn("groups", F.when(F.col("error").isNull() & (n > 0), groups))


def compact_pages(df: DataFrame, key: str, page: str) -> DataFrame:
    """(key, start, end, label): maximal runs of consecutive pages."""
    d = df.select(key, F.col(page).cast("bigint").alias("page")).distinct()
    d = ordered.with_previous(d, [key], ["page"], ["page"], starts=lambda c, p: c("page") != p("page") + 1)
    runs = d.groupBy(key, "island").agg(F.min("page").alias("start"), F.max("page").alias("end"))
    label = F.when(F.col("start") == F.col("end"), F.col("start").cast("string")).otherwise(
        F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")))
    return runs.select(key, "start", "end", label.alias("label"))


def concat_manifests(inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``inputs(job_id, source_no, source_id, page_index, bytes)`` to (one ordered manifest, job guard).

    Ordinals come from running page counts over the sources, not from sorting the pages."""
    sources = inputs.groupBy("job_id", "source_no").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    starts = ordered.running(sources, ["job_id"], ["source_no"], {"offset": F.col("n")}, inclusive=False)
    pages = inputs.join(starts.select("job_id", "source_no", "offset"), ["job_id", "source_no"]).select(
        "job_id", (F.col("offset") + F.col("page_index")).alias("ordinal"), "source_no", "source_id", "page_index")
    jobs = sources.groupBy("job_id").agg(
        F.count("*").alias("sources"), F.sum("n").alias("pages"), F.sum("bytes").alias("bytes"))
    reason = F.when(F.col("sources") < 2, "not-enough-files").when(F.col("bytes") > MAX_TOTAL_BYTES, "total-too-large").otherwise("ok")
    return pages, jobs.withColumn("status", reason)


def split_manifest(manifest: DataFrame, groups: DataFrame, base_name: str = "document") -> DataFrame:
    """Pages of every output: manifest rows + group_no and output name. ``groups(job_id, group_no, start, end, label)``."""
    wanted = groups.select(
        "job_id", "group_no", F.concat(F.lit(base_name + "-pages-"), "label", F.lit(".pdf")).alias("output"),
        F.explode(F.sequence("start", "end")).alias("page"))
    return wanted.join(manifest.withColumn("page", F.col("page_index") + 1), ["job_id", "page"])


def split_totals(split: DataFrame) -> DataFrame:
    return split.groupBy("job_id", "group_no", "output").agg(
        F.count("*").alias("page_count"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def _marked(manifest: DataFrame, selected: DataFrame) -> DataFrame:
    s = selected.select("job_id", "page_id").distinct().withColumn("__s", F.lit(1).cast("bigint"))
    return manifest.join(s, ["job_id", "page_id"], "left").withColumn("__s", F.coalesce("__s", F.lit(0).cast("bigint")))


def _counted(manifest: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected pages before each page."""
    d = _marked(manifest, selected).withColumnRenamed("__s", "chosen")
    return ordered.running(d, ["job_id"], ["ordinal"], {"before": F.col("chosen")}, inclusive=False)


def delete_pages(manifest: DataFrame, selected: DataFrame) -> DataFrame:
    d = _counted(manifest, selected).filter("chosen = 0")
    return d.withColumn("ordinal", F.col("ordinal") - F.col("before")).select(*manifest.columns)


def duplicate_pages(manifest: DataFrame, selected: DataFrame) -> DataFrame:
    """Each selected page is repeated right after itself (``copy`` = 1)."""
    d = _counted(manifest, selected).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chosen"))))
    return d.withColumn("ordinal", F.col("ordinal") + F.col("before") + F.col("copy")).select(*manifest.columns, "copy")


def rotate_pages(manifest: DataFrame, selected: DataFrame, clockwise: bool = True) -> DataFrame:
    d = _marked(manifest, selected)
    turn = F.when(F.col("__s") == 1, 90 if clockwise else -90).otherwise(0)
    return d.withColumn("rotation", quarter(F.col("rotation") + turn)).select(*manifest.columns)


def insert_pages(manifest: DataFrame, added: DataFrame, selected: DataFrame, position: str = "end") -> DataFrame:
    """``added`` has the manifest columns, ordinals dense from 0; position is end, before or after the first selected page."""
    size = manifest.groupBy("job_id").agg(F.count("*").alias("__n"))
    where = (
        manifest.join(selected.select("job_id", "page_id"), ["job_id", "page_id"], "left_semi")
        .groupBy("job_id").agg(F.min("ordinal").alias("__i"))
    )
    count = added.groupBy("job_id").agg(F.count("*").alias("__a"))
    at = F.col("__n") if position == "end" else F.coalesce(
        F.col("__i") + (1 if position == "after" else 0), F.col("__n"))
    plan = size.join(where, "job_id", "left").join(count, "job_id", "left").select(
        "job_id", at.alias("__at"), F.coalesce("__a", F.lit(0).cast("bigint")).alias("__a"))
    old = manifest.join(plan, "job_id").withColumn(
        "ordinal", F.col("ordinal") + F.when(F.col("ordinal") >= F.col("__at"), F.col("__a")).otherwise(0))
    new = added.join(plan, "job_id").withColumn("ordinal", F.col("ordinal") + F.col("__at"))
    return old.select(*manifest.columns).unionByName(new.select(*manifest.columns))


def move_pages(manifest: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves(job_id, page_id, target)``, one per job; targets outside the job change nothing."""
    size = manifest.groupBy("job_id").agg(F.count("*").alias("__n"))
    m = moves.join(manifest.select("job_id", "page_id", F.col("ordinal").alias("__from")), ["job_id", "page_id"])
    m = m.join(size, "job_id").filter((F.col("target") >= 0) & (F.col("target") < F.col("__n"))).select("job_id", "__from", "target")
    d = manifest.join(m, "job_id", "left")
    o, f, t = F.col("ordinal"), F.col("__from"), F.col("target")
    moved = F.when(f.isNull(), o).when(o == f, t).when((o > f) & (o <= t), o - 1).when((o < f) & (o >= t), o + 1).otherwise(o)
    return d.withColumn("ordinal", moved.cast("bigint")).select(*manifest.columns)


def job_guard(manifest: DataFrame, limit: int = MAX_JOB_PAGES) -> DataFrame:
    n = manifest.groupBy("job_id").agg(F.count("*").alias("pages"))
    return n.withColumn("status", F.when(F.col("pages") > limit, "workload-too-large").otherwise("ok"))


def quarter(angle: Column) -> Column:
    """Nearest quarter turn in 0, 90, 180, 270 (halves round up)."""
    return F.pmod(F.floor(angle / 90 + 0.5) * 90, F.lit(360)).cast("int")


def effective_rotation(manifest: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pending(job_id, page_index, adjust)`` may list a page several times; turns add up.

    Returns (manifest with ``effective``, changed pages per job)."""
    p = pending.groupBy("job_id", "page_index").agg(quarter(F.sum("adjust")).alias("__adj"))
    d = manifest.join(p.filter("__adj <> 0"), ["job_id", "page_index"], "left")
    adj = F.coalesce("__adj", F.lit(0))
    out = d.withColumn("effective", quarter(F.col("rotation") + adj))
    changed = d.groupBy("job_id").agg(F.sum((adj != 0).cast("bigint")).alias("changed"))
    return out.drop("__adj"), changed


NUMBER_FORMATS = ("number", "page-number", "number-of-total", "page-number-of-total")


def number_pages(
    manifest: DataFrame, selected: DataFrame, start: int = 1, style: str = "number", prefix: str = "", suffix: str = ""
) -> DataFrame:
    """Label the selected pages in order; the total is the number of selected pages."""
    if style not in NUMBER_FORMATS or start < 0:
        raise ValueError("invalid numbering options")
    d = _counted(manifest, selected).filter("chosen = 1")
    total = d.groupBy("job_id").agg(F.count("*").alias("total"))
    d = d.join(total, "job_id").withColumn("value", F.col("before") + start)
    value, n = F.col("value").cast("string"), F.col("total").cast("string")
    core = {
        "number": value, "page-number": F.concat(F.lit("Page "), value),
        "number-of-total": F.concat(value, F.lit(" of "), n),
        "page-number-of-total": F.concat(F.lit("Page "), value, F.lit(" of "), n),
    }[style]
    return d.select("job_id", "ordinal", "page_id", F.concat(F.lit(prefix), core, F.lit(suffix)).alias("label"))


def workload_guard(items: DataFrame, *, max_items: int, max_bytes: int, max_side: int, max_pixels: int) -> DataFrame:
    """``items(job_id, width, height, bytes)`` to (job_id, items, bytes, pixels, status)."""
    d = items.groupBy("job_id").agg(
        F.count("*").alias("items"), F.sum("bytes").alias("bytes"),
        F.sum(F.col("width").cast("bigint") * F.col("height")).alias("pixels"),
        F.max(F.greatest("width", "height")).alias("side"),
    )
    status = (
        F.when(F.col("items") > max_items, "too-many-items").when(F.col("bytes") > max_bytes, "total-too-large")
        .when(F.col("side") > max_side, "dimensions-too-large").when(F.col("pixels") > max_pixels, "workload-too-large")
        .otherwise("ok")
    )
    return d.select("job_id", "items", "bytes", "pixels", status.alias("status"))
