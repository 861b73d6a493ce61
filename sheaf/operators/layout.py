"""Positioned text to lines, segments, columns and tables.

``spans(doc_id, page, span_no, text, x, y, width, size[, bold])`` in points, top down.
A page meets in one task. Its rows stream through windows; where a rule depends on what it decided before, and only there, the
page is walked by a fold. Lines, segments and runs of a page need one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sheaf.functions import pagewise
from sheaf.functions.text import WS, is_blank, js_trim, search_token

PAGE = ["doc_id", "page"]


def split_words(boxes: DataFrame) -> DataFrame:
    """One row per word of ``boxes(…, text, x, y, angle, width, height)``, placed by character offset."""
    tokens = F.regexp_extract_all("text", F.lit(r"[^\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"), 0)
    d = boxes.withColumn("__tok", tokens)
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<text:string,start:int>>").alias("out"))

    def step(acc, token):
        # Only white space lies between two words, so the next occurrence is the word itself.
        found = F.call_function("locate", token, F.col("text"), acc["at"])
        return F.struct((found + F.length(token)).alias("at"),
                        F.concat(acc["out"], F.array(F.struct(token.alias("text"), (found - 1).alias("start")))).alias("out"))

    placed = F.aggregate("__tok", zero, step, lambda a: a["out"])
    keep = [c for c in boxes.columns if c not in ("text", "x", "y", "width")]
    d = d.select(*keep, "text", "x", "y", "width", F.posexplode(placed).alias("word_no", "w"), F.size("__tok").alias("n"))
    share = lambda c: c / F.length("text")
    whole = F.col("n") == 1
    offset = F.when(whole, 0.0).otherwise(F.col("width") * share(F.col("w.start")))
    radians = F.radians("angle")
    return d.select(
        *keep, "word_no", F.col("w.text").alias("text"), (F.col("x") + F.cos(radians) * offset).alias("x"),
        (F.col("y") + F.sin(radians) * offset).alias("y"),
        F.when(whole, F.col("width")).otherwise(F.col("width") * share(F.length("w.text"))).alias("width"),
    )


def project_boxes(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Recognised pixel boxes back to page points.

    ``words(doc_id, page, …, x0, y0, x1, y1)``, ``pages(doc_id, page, width, height, rotation, px_width,
    px_height)``; rotation is the clockwise turn applied before recognition. Adds x, y (bottom up), angle,
    width, height and drops specks."""
    d = words.join(pages, PAGE)
    swap = F.col("rotation").isin(90, 270)
    W, H = F.col("pw"), F.col("ph")
    d = d.withColumnsRenamed({"width": "pw", "height": "ph"})
    sx = F.when(swap, H).otherwise(W) / F.col("px_width")
    sy = F.when(swap, W).otherwise(H) / F.col("px_height")

    def back(x: Column, y: Column) -> tuple[Column, Column]:
        r = F.col("rotation")
        px = F.when(r == 90, y).when(r == 180, W - x).when(r == 270, W - y).otherwise(x)
        py = F.when(r == 90, H - x).when(r == 180, H - y).when(r == 270, x).otherwise(y)
        return px, H - py

    (ax, ay), (bx, by), (tx, ty) = (
        back(F.col("x0") * sx, F.col("y1") * sy), back(F.col("x1") * sx, F.col("y1") * sy), back(F.col("x0") * sx, F.col("y0") * sy))
    d = d.withColumns({
        "x": ax, "y": ay, "angle": F.degrees(F.atan2(by - ay, bx - ax)),
        "width": F.hypot(bx - ax, by - ay), "height": F.hypot(tx - ax, ty - ay),
    })
    return d.filter("width > 1 AND height > 1").select(*words.columns, "x", "y", "angle", "width", "height")


def _grouped(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per group with its rows in order (``m``). Pages and stretches are physically small."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("m"))


def _rows_udf(rule: Callable, returns: str):
    """Arrow UDF over whole groups: many groups per batch, NULL groups skipped."""

    @F.pandas_udf(returns)
    def run(groups: pd.Series) -> pd.Series:
        return groups.map(lambda g: None if g is None else rule(g))

    return run


def _clusters(d: DataFrame, keys: Sequence[str], order: Sequence[str], apart: Column, wide: Callable[[Column], Column], fold: Callable, name: str) -> DataFrame:
    """Add the number of each row's cluster, from 1, in one shuffle by ``keys``; what follows by page or line needs no other.

    A row that is ``apart`` from the one before opens a cluster for sure. Where no row is ``wide``, given the first value of
    ``order`` in its stretch, no other does. Only pages with a wide row are walked: ``fold`` gives, of the array of
    a page's rows ``__row``, the numbers of those that open a cluster, and one row of the page does so."""
    page = Window.partitionBy(*keys)
    seq = page.orderBy(*order)
    so_far = seq.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__apart", F.coalesce(apart, F.lit(True))).withColumns({
        "__at": F.row_number().over(seq), name: F.sum(F.col("__apart").cast("bigint")).over(so_far),
        "__least": F.max(F.when(F.col("__apart"), F.col(order[0]))).over(so_far)})
    d = d.withColumn("__wide", F.max(wide(F.col("__least"))).over(page)).drop("__apart", "__least")
    rows = F.collect_list(F.when(F.col("__wide"), F.col("__row"))).over(seq.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = d.withColumn("__rows", rows).withColumn("__opens", F.when(F.col("__wide") & (F.col("__at") == 1), fold(F.col("__rows")))).drop("__rows", "__row")
    d = d.withColumn("__opens", F.max("__opens").over(page))
    walked = F.size(F.filter("__opens", lambda i: i <= F.col("__at"))).cast("bigint")
    return d.withColumn(name, F.when(F.col("__wide"), walked).otherwise(F.col(name))).drop("__at", "__opens", "__wide")


def _walk(rows: Column, zero: dict[str, Column], step: Callable[[Column, Column], tuple[Column, dict[str, tuple[Column, Column]]]]) -> Column:
    """Numbers, from 1, of the rows that open a cluster. ``step(acc, row)`` tells whether a row does and, by name, the state
    after it if so and if not."""
    start = F.struct(F.lit(0).alias("i"), F.array().cast("array<int>").alias("out"), *[v.alias(k) for k, v in zero.items()])

    def one(acc: Column, row: Column) -> Column:
        opens, state = step(acc, row)
        i = acc["i"] + 1
        return F.struct(i.alias("i"), F.when(opens, F.concat(acc["out"], F.array(i))).otherwise(acc["out"]).alias("out"),
                        *[F.when(opens, a).otherwise(b).alias(k) for k, (a, b) in state.items()])

    return F.aggregate(rows, start, one, lambda acc: acc["out"])


def cluster_lines(spans: DataFrame, mode: str = "word") -> DataFrame:
    """spans + ``line_no`` (dense per page, top down).

    A span leaves the line when it is farther from the line's first baseline than the tolerance:
    ``word`` max(1, 0.3 of the smaller size), ``title`` the same with 0.35, ``text`` 0.45 of the larger size."""
    d = spans.filter(~is_blank("text") & (F.abs(F.col("x") + F.col("y") + F.col("width") + F.col("size")) < float("inf")))
    share = {"word": 0.3, "title": 0.35, "text": 0.45}[mode]
    seq = Window.partitionBy(*PAGE).orderBy("y", "x", "span_no")
    size = F.col("size").cast("double")
    # The farthest that a span can be from its line, and what never is too far.
    most = share * F.greatest(F.max(size).over(seq.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)) if mode == "text" else F.greatest(F.lit(1.0), share * size)
    least = share if mode == "text" else 1.0
    limit = (lambda a, s: share * F.greatest(a, s, F.lit(1.0))) if mode == "text" else (lambda a, s: F.greatest(F.lit(1.0), share * F.least(a, s)))

    def step(acc: Column, r: Column):
        opens = acc["anchor"].isNull() | (F.abs(acc["anchor"] - r["y"]) > limit(acc["size"], r["size"]))
        return opens, {"anchor": (r["y"], acc["anchor"]), "size": (r["size"], F.greatest(acc["size"], r["size"]))}

    zero = {"anchor": F.lit(None).cast("double"), "size": F.lit(0.0)}
    d = d.withColumn("__row", F.struct(F.col("y").cast("double").alias("y"), size.alias("size")))
    return _clusters(d, PAGE, ["y", "x", "span_no"], F.col("y") - F.lag("y").over(seq) > most, lambda first: F.col("y") - first > least,
                     lambda rows: _walk(rows, zero, step), "line_no")


def line_text(lined: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, text, x, right, y, size, emphasis): the spans of a line joined.

    Split words and punctuation stay together; a real gap becomes one blank."""
    bold = F.col("bold") if "bold" in lined.columns else F.lit(False)
    member = F.struct("x", "span_no", "text", "width", "size", "y", bold.alias("bold"))
    g = lined.groupBy(*PAGE, "line_no").agg(
        F.sort_array(F.collect_list(member)).alias("m"), F.min("x").alias("x"), F.max(F.col("x") + F.col("width")).alias("right"),
        F.min(F.struct("y", "x")).alias("f"), F.max("size").alias("size"),
    )

    def piece(s: Column, i: Column) -> Column:
        p = F.get("m", i - 1)
        gap = s["x"] - p["x"] - p["width"]
        tight = (gap < F.least(p["size"], s["size"]) * 0.12) | s["text"].rlike(r"^[,.;:!?)}\]]") | p["text"].rlike(r"[({\[]\z")
        apart = p["text"].rlike(WS + r"\z") | s["text"].rlike("^" + WS)
        blank = F.when(i == 0, "").when(apart, " ").when(tight, "").otherwise(" ")
        return F.concat(blank, js_trim(s["text"]))

    text = F.array_join(F.transform("m", piece), "")
    loud = F.aggregate("m", F.lit(0), lambda a, s: a + F.when(s["bold"], F.length(s["text"])).otherwise(0))
    return g.select(
        *PAGE, "line_no", text.alias("text"), "x", "right", F.col("f.y").alias("y"), "size",
        (loud / F.greatest(F.lit(1), F.length(text))).alias("emphasis"))


def segment_lines(words: DataFrame, mode: str = "table") -> DataFrame:
    """(doc_id, page, line_no, seg_no, x0, x1, text, size, confidence, y): a line cut at wide gaps, y its top baseline.

    ``words`` carry line_no, order (``span_no``), text, x0, x1, size and optionally confidence. Limits:
    ``table`` max(14, 2.4 size), ``prose`` max(14, 1.5 size), ``ocr`` max(25, 2.2 size)."""
    floor, ratio = {"table": (14.0, 2.4), "prose": (14.0, 1.5), "ocr": (25.0, 2.2)}[mode]
    line = [*PAGE, "line_no"]
    d = words.filter(~is_blank("text"))
    if "confidence" not in d.columns:
        d = d.withColumn("confidence", F.lit(100.0))
    # A line is one row of glyphs on one page.
    w = Window.partitionBy(*line).orderBy("x0", "span_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.lag("x1").over(w) if mode == "ocr" else F.max("x1").over(before)
    # The line's size is that of its first word on the page for tables, its largest for prose.
    size = F.min(F.struct("y", "x0", "span_no", "size")).over(Window.partitionBy(*line))["size"] if mode == "table" else F.max("size").over(Window.partitionBy(*line))
    d = d.withColumns({"reach": reach, "lsize": size, "top": F.min("y").over(Window.partitionBy(*line))})
    limit = F.greatest(F.lit(floor), F.col("lsize") * ratio)
    gap = F.col("x0") - F.col("reach")
    opens = F.col("reach").isNull() | ((gap > limit) if mode == "table" else (gap >= limit))
    d = d.withColumn("seg_no", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    member = F.sort_array(F.collect_list(F.struct("x0", "span_no", "text")))
    return d.groupBy(*line, "seg_no").agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.array_join(F.transform(member, lambda m: js_trim(m["text"])), " ").alias("text"),
        F.max("lsize").alias("size"), F.min("confidence").alias("confidence"), F.min("top").alias("y"))


def segmented(segments: DataFrame) -> DataFrame:
    """One row per line with its segments as an array."""
    top = [F.min("y").alias("y")] if "y" in segments.columns else []
    return segments.groupBy(*PAGE, "line_no").agg(
        F.sort_array(F.collect_list(F.struct("seg_no", "x0", "x1", "text", "confidence"))).alias("segs"), F.max("size").alias("size"), *top)


def snapped(lines: DataFrame, xs: str, tolerance: Column, right_edges: bool = False) -> DataFrame:
    """lines + ``cols``: columns of the segments (nearest boundary, first on ties), NULL when the line does not fit."""
    near = lambda s: F.array_min(F.transform(xs, lambda x, i: F.struct(F.abs(s["x0"] - x).alias("d"), i.alias("c"))))
    # Found once a line, then read as a column.
    d = lines.withColumn("__found", F.transform("segs", near)).withColumn("__tolerance", tolerance)
    cols = F.col("__found")["c"]
    fits = F.forall("__found", lambda f: f["d"] <= F.col("__tolerance")) & (F.size(F.array_distinct(cols)) == F.size("__found"))
    if right_edges:
        crosses = F.zip_with("segs", "__found", lambda s, f: s["x1"] > F.coalesce(F.get(F.col(xs), f["c"] + 1) - 0.5 * F.col("__tolerance"), F.lit(float("inf"))))
        fits = fits & ~F.exists(crosses, lambda c: c)
    return d.withColumn("cols", F.when(fits, cols)).drop("__found", "__tolerance")


def snap_columns(lines: DataFrame, boundaries: DataFrame, right_edges: bool = False) -> DataFrame:
    """(doc_id, page, line_no, col, text) of lines that fit ``boundaries(doc_id, page, xs ARRAY, tolerance)``."""
    d = snapped(lines.join(boundaries, PAGE), "xs", F.col("tolerance"), right_edges)
    z = F.explode(F.arrays_zip("cols", "segs")).alias("z")
    return d.filter("cols IS NOT NULL").select(*PAGE, "line_no", z).select(*PAGE, "line_no", F.col("z.cols").alias("col"), F.col("z.segs.text").alias("text"))


def _run_tables(runs: DataFrame, ocr: bool) -> DataFrame:
    """(doc_id, page, run_no, line_no, columns, col, text) of the runs that read as one grid.

    The densest line gives the columns; the gates are plain aggregates over the run."""
    key = [*PAGE, "run_no"]
    n = F.size("segs")
    reference = F.max_by(F.struct(F.transform("segs", lambda s: s["x0"]).alias("xs"), "size"), F.struct(n, -F.col("line_no")))
    # Windows by run: the lines of a page are in one task already, and none is joined back.
    run = Window.partitionBy(*key)
    d = runs.withColumns({
        "lines": F.count("*").over(run), "full": F.sum((n >= 2).cast("int")).over(run), "r": reference.over(run),
        "confidence": F.sum(F.aggregate("segs", F.lit(0.0), lambda a, s: a + s["confidence"])).over(run) / F.sum(n).over(run),
    }).filter("full >= 3")
    if ocr:
        d = d.filter("(lines - full) / lines <= 0.4 AND confidence >= 50")
    floor = 15.0 if ocr else 7.0
    tolerance = F.greatest(F.lit(floor), F.col("r.size") * 1.5)
    d = snapped(d.withColumns({"xs": F.col("r.xs"), "tolerance": tolerance}).drop("r"), "xs", F.col("tolerance"), ocr)
    # Lengths are asked of tables of two columns only, and a column has one segment a line at most.
    place = lambda c: F.when(F.size("xs") == 2, F.array_position("cols", F.lit(c)))
    d = d.withColumns({f"size{c}": F.when(place(c) > 0, F.length(js_trim(F.get(F.col("segs")["text"], (place(c) - 1).cast("int"))))) for c in (0, 1)})
    size_of = lambda c: F.col(f"size{c}")
    d = d.withColumns({
        "misfits": F.sum(F.col("cols").isNull().cast("int")).over(run), "columns": F.size("xs"),
        **{f"max{c}": F.max(size_of(c)).over(run) for c in (0, 1)}, **{f"min{c}": F.min(F.nullif(size_of(c), F.lit(0))).over(run) for c in (0, 1)}})
    even = lambda c: F.coalesce((F.col(f"max{c}") <= 16) & (F.col(f"max{c}") <= 2.5 * F.col(f"min{c}")), F.lit(False))
    fit = (F.col("misfits") == 0) if ocr else (F.col("misfits") / F.col("lines") <= 0.2)
    rows = d.filter(fit & (F.col("columns") >= 2) & ((F.col("columns") > 2) | (even(0) & even(1)))).filter("cols IS NOT NULL")
    rows = rows.select(*key, "line_no", "columns", F.explode(F.arrays_zip("cols", "segs")).alias("z"))
    return rows.select(*key, "line_no", "columns", F.col("z.cols").alias("col"), F.col("z.segs.text").alias("text"))


def detect_tables(lines: DataFrame) -> DataFrame:
    """Tables of text lines (:func:`segmented`): runs of at least three lines with two or more segments."""
    # line_no is dense over all lines, so a missing number is a line with a single segment.
    n = F.size("segs")
    seq = Window.partitionBy(*PAGE).orderBy("line_no")
    d = lines.filter(n >= 2).withColumn("__row", F.struct(F.col("line_no").cast("bigint").alias("line"), n.alias("n")))
    d = d.withColumn("__span", F.max(n).over(Window.partitionBy(*PAGE)) - F.min(n).over(Window.partitionBy(*PAGE)))

    def step(acc: Column, r: Column):
        # counts by number of segments, in the order met; the first of the most frequent is the mode
        mode = F.get(acc["ns"], (F.array_position(acc["counts"], F.array_max(acc["counts"])) - 1).cast("int"))
        opens = acc["last"].isNull() | (r["line"] != acc["last"] + 1) | (F.abs(r["n"] - mode) > 1)
        at = F.array_position(acc["ns"], r["n"])
        added = F.when(at > 0, F.transform(acc["counts"], lambda c, i: F.when(i == at - 1, c + 1).otherwise(c))).otherwise(F.concat(acc["counts"], F.array(F.lit(1))))
        return opens, {"last": (r["line"], r["line"]), "ns": (F.array(r["n"]), F.when(at > 0, acc["ns"]).otherwise(F.concat(acc["ns"], F.array(r["n"])))),
                       "counts": (F.array(F.lit(1)), added)}

    zero = {"last": F.lit(None).cast("bigint"), "ns": F.array().cast("array<int>"), "counts": F.array().cast("array<int>")}
    runs = _clusters(d, PAGE, ["line_no"], F.col("line_no") != F.lag("line_no").over(seq) + 1, lambda _: F.col("__span") > 1,
                     lambda rows: _walk(rows, zero, step), "run_no").drop("__span")
    return _run_tables(runs, ocr=False)


def detect_tables_ocr(lines: DataFrame) -> DataFrame:
    """As :func:`detect_tables` for recognised lines: up to two single-segment lines may stand between rows."""
    d = lines.filter(F.size("segs") > 0)
    seq = Window.partitionBy(*PAGE).orderBy("line_no")
    d = d.withColumn("i", F.row_number().over(seq))
    row_like = F.size("segs") >= 2
    d = d.withColumn("last", F.max(F.when(row_like, F.col("i"))).over(seq.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("opens", (row_like & (F.col("last").isNull() | (F.col("i") - F.col("last") > 2))).cast("bigint"))
    runs = d.withColumn("run_no", F.sum("opens").over(seq.rowsBetween(Window.unboundedPreceding, 0))).filter("run_no > 0")
    return _run_tables(runs.drop("last", "i", "opens"), ocr=True)


def _band_starts(at: Column, mode: str) -> Column:
    """Indices of sorted positions that open a band: farther than the tolerance from its first (``word``) or from the
    upper median of its positions so far (``vector``)."""
    first = F.struct(F.lit(0).alias("first"), F.array(F.lit(0)).alias("out"))
    limit = BAND[mode]

    def step(acc: Column, i: Column) -> Column:
        held = acc["first"] if mode == "word" else acc["first"] + F.floor((i - acc["first"]) / 2).cast("int")
        opens = F.abs(F.get(at, i) - F.get(at, held)) > limit
        return F.struct(F.when(opens, i).otherwise(acc["first"]).alias("first"),
                        F.when(opens, F.concat(acc["out"], F.array(i))).otherwise(acc["out"]).alias("out"))

    more = F.when(F.size(at) > 1, F.sequence(F.lit(1), F.size(at) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(more, first, step, lambda acc: acc["out"])


#: How far a rule may be from its band.
BAND = {"word": 1.4999999999, "vector": 1.5}


def merge_intervals(rules: DataFrame, horizontal: bool, mode: str = "word") -> DataFrame:
    """(doc_id, page, band_no, position, start, end): collinear rules joined.

    ``word`` bands lie within 1.5 of their first rule and join at gaps below 2; ``vector`` bands lie within
    1.5 of their running median, carry that median and join at gaps up to 2.5.

    A gap beyond the tolerance always opens a band, and rules within it of the first after such a gap are one band; only
    where they reach farther is the rule followed one position after the other."""
    a, b = ("y", "x") if horizontal else ("x", "y")
    d = rules.filter((F.abs(F.col(a + "1") - F.col(a + "0")) < 1.5) & (F.col(b + "1") - F.col(b + "0") > 3)).select(
        *PAGE, F.col(a + "0").alias("pos"), F.col(b + "0").alias("start"), F.col(b + "1").alias("end"))
    # One shuffle by page; its rules, in the order of their positions, stream through windows.
    page = Window.partitionBy(*PAGE)
    seq = page.orderBy("pos", "start", "end")
    so_far = seq.rowsBetween(Window.unboundedPreceding, 0)
    apart = F.coalesce(F.col("pos") - F.lag("pos").over(seq) > BAND[mode], F.lit(True))
    d = d.withColumn("apart", apart).withColumns({
        "at": F.row_number().over(seq), "group": F.sum(F.col("apart").cast("bigint")).over(so_far), "least": F.max(F.when(F.col("apart"), F.col("pos"))).over(so_far)})
    d = d.withColumn("wide", F.max(F.col("pos") - F.col("least") > BAND[mode]).over(page)).drop("apart", "least")
    d = d.withColumn("all", F.collect_list(F.when(F.col("wide"), F.col("pos"))).over(seq.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # Where bands open on a page with a wide group is found once, at its first rule.
    d = d.withColumn("bands", F.when(F.col("wide") & (F.col("at") == 1), _band_starts(F.col("all"), mode))).drop("all")
    d = d.withColumn("bands", F.max("bands").over(page))
    d = d.withColumn("band_no", F.when(F.col("wide"), F.size(F.filter("bands", lambda s: s < F.col("at"))).cast("bigint")).otherwise(F.col("group"))).drop("bands", "wide", "group")
    band = [*PAGE, "band_no"]
    own = Window.partitionBy(*band)
    along = own.orderBy("start", "end", "pos")
    gap = F.col("start") - F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("opens", F.coalesce((gap >= 2) if mode == "word" else (gap > 2.5), F.lit(True)))
    d = d.withColumn("part", F.sum(F.col("opens").cast("bigint")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    position = F.max(F.when(F.col("opens"), F.col("pos")))
    if mode == "vector":
        # A band's position is the upper median of its rules, which are numbered in that order.
        middle = F.col("at") - F.min("at").over(own) == F.floor(F.count("*").over(own) / 2)
        d = d.withColumn("middle", middle).withColumn("middle", F.max(F.when(F.col("middle"), F.col("pos"))).over(own))
        position = F.max("middle")
    out = d.groupBy(*band, "part").agg(position.alias("position"), F.min("start").alias("start"), F.max("end").alias("end"))
    return out.select(*band, "position", "start", "end")


def covered_share(intervals: DataFrame, windows: DataFrame, key: Sequence[str]) -> DataFrame:
    """``windows(key…, w_start, w_end)`` + share of their length that ``intervals(key…, start, end)`` cover.

    Overlapping intervals count once; an empty window has share 0; repeated windows each give a row. A sweep over all
    end points of a key keeps how many intervals are open and the length covered so far; a window is the difference of
    two places of the sweep, so windows and intervals never meet pairwise. The only shuffle is by key; a key's places
    stream through one window there, and nothing is joined back."""
    key = list(key)
    rest = [c for c in windows.columns if c not in key]
    ends = [F.col(c).cast("double").alias(n) for c, n in (("start", "a"), ("end", "b"))]
    kept = intervals.filter(F.col("end") > F.col("start")).select(*key, *ends)
    # A window's two ends come from one row, so that its number pairs them.
    asked = windows.withColumn("__w", F.monotonically_increasing_id()).select(
        *key, F.col("w_start").cast("double").alias("a"), F.col("w_end").cast("double").alias("b"), F.struct("__w", *rest).alias("window"))
    d = kept.unionByName(asked, allowMissingColumns=True).repartition(*key)
    place = lambda x, opens, last: F.struct(F.col(x).alias("x"), F.when(F.col("window").isNull(), opens).otherwise(0).alias("opens"), F.lit(last).alias("ends"))
    d = d.select(*key, "window", F.inline(F.array(place("a", 1, False), place("b", -1, True))))
    sweep = Window.partitionBy(*key).orderBy("x")
    before, so_far = sweep.rowsBetween(Window.unboundedPreceding, -1), sweep.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.sum("opens").over(before) > 0, F.col("x") - F.lag("x").over(sweep)).otherwise(F.lit(0.0))
    d = d.withColumn("step", step).withColumn("covered", F.sum("step").over(so_far)).filter("window IS NOT NULL")
    d = d.select(*key, "window.*", F.when(F.col("ends"), F.col("covered")).otherwise(-F.col("covered")).alias("__length"))
    d = d.groupBy(*key, "__w", *rest).agg(F.sum("__length").alias("__length"))
    share = F.when(F.col("w_end") > F.col("w_start"), F.col("__length") / (F.col("w_end") - F.col("w_start"))).otherwise(F.lit(0.0))
    return d.select(*windows.columns, share.alias("share"))


def ruled_tables(spans: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, page, table_no, row, col, span_no): closed grids of rules.

    Rules are merged, and two that follow each other with the same ends bound a band. Its column edges are the
    upright rules that cross it, and spans join the bands they lie in. What reaches Python is a page's bands with
    the columns of their spans, to stack them."""
    ends = [*PAGE, "l3", "r3"]
    h = merge_intervals(rules, True).withColumns({"l3": F.floor(F.col("start") / 3 + 0.5), "r3": F.floor(F.col("end") / 3 + 0.5)})
    group = Window.partitionBy(*ends)
    bands = h.select(
        *ends, F.min("position").over(group).alias("first"), F.col("position").alias("top"), F.col("start").alias("left"), F.col("end").alias("right"),
        F.lead("position").over(group.orderBy("position", "start", "end")).alias("bottom")).filter("bottom - top >= 6")
    upright = merge_intervals(rules, False).groupBy(*PAGE).agg(F.collect_list(F.struct("position", "start", "end")).alias("v"))
    crossing = F.filter("v", lambda r: (
        (r["start"] <= F.col("top") + 2) & (r["end"] >= F.col("bottom") - 2)
        & (r["position"] >= F.col("left") - 2) & (r["position"] <= F.col("right") + 2)))
    bands = bands.join(upright, PAGE).withColumn("e", F.array_sort(F.transform(crossing, lambda r: r["position"]))).drop("v")
    n = F.size("e")
    closed = n.between(3, 21) & (F.abs(F.get("e", F.lit(0)) - F.col("left")) <= 3) & (F.abs(F.get("e", n - 1) - F.col("right")) <= 3)
    bands = bands.withColumn("edges", F.when(closed, F.col("e"))).drop("e")

    words = spans.filter(~is_blank("text")).select(
        F.col("doc_id").alias("d"), F.col("page").alias("p"), "span_no", "x", "y", (F.col("x") + F.col("width")).alias("x1"))
    within = (
        (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")) & F.col("edges").isNotNull()
        & (F.col("y") > F.col("top")) & (F.col("y") <= F.col("bottom") + 1) & (F.col("x") >= F.col("left") - 1) & (F.col("x1") <= F.col("right") + 2))
    at = F.size(F.filter("edges", lambda e: e - 1 <= F.col("x"))) - 1
    inside = (at >= 0) & (F.col("x1") <= F.get("edges", at + 1) + 2)  # no edge follows the last: null
    placed = F.when(F.col("span_no").isNotNull(), F.struct("span_no", F.when(inside, at).otherwise(-1).alias("col")))
    rows = bands.join(words, within, "left").groupBy(*ends, "first", "top", "bottom", "edges").agg(F.collect_list(placed).alias("cells"))
    pages = _grouped(rows, PAGE, ["first", "l3", "r3", "top"])

    def stack(page) -> list:
        grids = pagewise.stacked_bands(
            ((b["l3"], b["r3"]), b["top"], b["bottom"], b["edges"], [(c["span_no"], c["col"]) for c in b["cells"]]) for b in page)
        return [(t, r, int(c), int(n)) for t, grid in enumerate(grids) for r, cells in enumerate(grid) for n, c in cells.items()]

    found = _rows_udf(stack, "array<struct<table_no:int,row:int,col:int,span_no:int>>")
    return pages.select(*PAGE, F.inline(found("m")))


def borderless_tables(lines: DataFrame) -> DataFrame:
    """(doc_id, page, table_no, row, col, text): repeated column starts without rules.

    ``lines(doc_id, page, line_no, y, size, segs)``. A gap over four sizes cuts a page into stretches; only stretches
    of three lines or more with at least two segments somewhere reach Python, one per group."""
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    d = lines.select(*PAGE, "line_no", "y", "size", "segs").withColumn("far", F.col("y") - F.lag("y").over(w) > F.col("size") * 4)
    d = d.withColumn("stretch", F.count(F.when(F.col("far"), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("far")
    g = _grouped(d, [*PAGE, "stretch"], ["line_no"]).filter((F.size("m") >= 3) & F.exists("m", lambda r: F.size(r["segs"]) >= 2))

    def run(lines_) -> list:
        stretch = [(r["y"], r["size"], [(s["x0"], s["x1"], s["text"]) for s in r["segs"]]) for r in lines_]
        return [
            (t, r, c, " ".join(cell)) for t, rows in enumerate(pagewise.column_runs(stretch))
            for r, row in enumerate(rows) for c, cell in enumerate(row)]

    found = _rows_udf(run, "array<struct<t:int,row:int,col:int,text:string>>")
    cells = g.select(*PAGE, "stretch", F.inline(found("m")))
    number = F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("stretch", "t")) - 1
    return cells.select(*PAGE, number.alias("table_no"), "row", "col", "text")


def grid_components(cells: DataFrame, open_sides: DataFrame) -> DataFrame:
    """(doc_id, page, row, col, anchor_row, anchor_col, rectangular): cells without a rule between them.

    ``cells(doc_id, page, row, col)``, ``open_sides(doc_id, page, row, col, to_row, to_col)``. Components that
    are no rectangle stay single cells."""
    grid = cells.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("row", "col"))).alias("m"))
    links = open_sides.groupBy(*PAGE).agg(F.collect_list(F.struct("row", "col", "to_row", "to_col")).alias("s"))
    # Pages without an open side keep every cell to itself.
    d = grid.join(links, PAGE, "left")

    @F.pandas_udf("array<int>")
    def label(pages: pd.DataFrame) -> pd.Series:
        out = []
        for m, s in zip(pages["m"], pages["s"]):
            if s is None:
                out.append(None)
                continue
            index = {(r["row"], r["col"]): i for i, r in enumerate(m)}
            pairs = [(index[a["row"], a["col"]], index[a["to_row"], a["to_col"]]) for a in s]
            out.append(pagewise.components(len(m), pairs))
        return pd.Series(out)

    d = d.withColumn("l", label(F.struct(F.when(F.col("s").isNotNull(), F.col("m")).alias("m"), "s")))
    comp = F.coalesce("l", F.transform("m", lambda x, i: i))
    joined = d.select(*PAGE, F.explode(F.arrays_zip("m", comp.alias("comp"))).alias("z")).select(*PAGE, "z.m.*", F.col("z.comp").alias("comp"))
    # A page's cells are in one task already: its components are windows there.
    own = Window.partitionBy(*PAGE, "comp")
    d = joined.withColumns({
        "n": F.count("*").over(own), "r0": F.min("row").over(own), "r1": F.max("row").over(own), "c0": F.min("col").over(own), "c1": F.max("col").over(own)})
    whole = F.col("n") == (F.col("r1") - F.col("r0") + 1) * (F.col("c1") - F.col("c0") + 1)
    return d.select(
        *PAGE, "row", "col", F.when(whole, F.col("r0")).otherwise(F.col("row")).alias("anchor_row"),
        F.when(whole, F.col("c0")).otherwise(F.col("col")).alias("anchor_col"), whole.alias("rectangular"))


def component_merges(components: DataFrame) -> DataFrame:
    d = components.filter("rectangular").groupBy(*PAGE, "anchor_row", "anchor_col").agg(
        F.max("row").alias("end_row"), F.max("col").alias("end_col"))
    return d.filter("end_row > anchor_row OR end_col > anchor_col").select(
        *PAGE, F.col("anchor_row").alias("start_row"), "end_row", F.col("anchor_col").alias("start_col"), "end_col")


def assign_words_to_grid(words: DataFrame, edges: DataFrame, tolerance: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(cell texts, per-page counts). ``edges(doc_id, page, xs ARRAY, ys ARRAY)``; words sit at their centre
    (cx, cy). A new line starts when the centre drops by more than 0.6 of the larger size."""
    def locate(e: str, v: str) -> Column:
        # The first interval that holds the value; its start is the last candidate edge to pass.
        spots = F.sequence(F.lit(0), F.size(e) - 2)
        return F.try_element_at(F.filter(spots, lambda i: (F.col(v) >= F.get(e, i) - tolerance) & (F.col(v) < F.get(e, i + 1) + tolerance)), F.lit(1))

    # Edges are one row a page, so words needn't be sorted to meet them.
    d = words.join(edges.hint("shuffle_hash"), PAGE).withColumns({"row": locate("ys", "cy"), "col": locate("xs", "cx")})
    d = d.drop("xs", "ys")
    placed = d.filter("row IS NOT NULL AND col IS NOT NULL")
    member = F.array_sort(F.collect_list(F.struct("cy", "cx", "word_no", "text", "size")))

    def piece(m: Column, i: Column) -> Column:
        p = F.get("m", i - 1)
        sep = F.when(i == 0, "").when(F.abs(m["cy"] - p["cy"]) > F.greatest(m["size"], p["size"]) * 0.6, "\n").otherwise(" ")
        return F.concat(sep, m["text"])

    cells = placed.groupBy(*PAGE, "row", "col").agg(member.alias("m"))
    cells = cells.select(*PAGE, "row", "col", F.array_join(F.transform("m", piece), "").alias("text"))
    assigned = F.col("row").isNotNull() & F.col("col").isNotNull()
    counts = d.groupBy(*PAGE).agg(F.count("*").alias("words"), F.sum(assigned.cast("bigint")).alias("assigned"))
    return cells, counts


# Fixed pattern: bullets, numbered and lettered list items.
LIST_START = rf"(?i)^(?:[•-]{WS}|\(?\d{{1,3}}[.)]{WS}|\(?[a-zivx]{{1,5}}[.)]{WS})"


def paragraph_blocks(lines: DataFrame, margins: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, block_no, kind, alignment): headings, paragraphs and signature blocks.

    ``lines`` as from :func:`line_text`, ``margins(doc_id, page, left, right)``. What a line and its neighbours tell
    are window columns; only the block's pitch, which depends on the lines before, is a state step in Python."""
    page = Window.partitionBy(*PAGE)
    seq = page.orderBy("line_no")
    d = lines.select(*PAGE, "line_no", "text", "x", "right", "y", "size", "emphasis").join(
        margins.select(*PAGE, F.col("left").alias("edge"), (F.col("right") - F.col("left")).alias("room")), PAGE)
    d = d.withColumns({"sizes": F.collect_list("size").over(page), "at": F.row_number().over(seq)})
    middle = F.get(F.sort_array("sizes"), F.floor(F.size("sizes") / 2).cast("int"))
    d = d.withColumn("body", F.when(F.col("at") == 1, middle)).drop("sizes", "at").withColumns({
        "body": F.max("body").over(page), "wide": F.col("right") - F.col("x"),
        "up": F.lag(F.struct("text", "x", "size", (F.col("right") - F.col("x")).alias("wide"))).over(seq),
        "gap": F.col("y") - F.lag("y").over(seq), "ahead": F.lead("y").over(seq) - F.col("y"), "next_x": F.lead("x").over(seq)})
    body, room, x, up, gap = (F.col(c) for c in ("body", "room", "x", "up", "gap"))

    strong, short = F.col("emphasis") > 0.6, F.col("wide") < room * 0.68
    middle = F.abs((x + F.col("right") - F.col("edge") * 2 - room) / 2) < body
    aside = short & (x > F.col("edge") + room * 0.52)
    d = d.withColumns({
        "kind": F.when(aside, "signature").when(strong, "heading").otherwise("paragraph"),
        "alignment": F.when(aside, "right").when(short & (strong | (F.length("text") < 48)) & middle, "center").otherwise("left")})
    half = F.when((gap > body * 0.7) & (gap < body * 3), F.floor(gap * 2 + 0.5) / 2)
    d = d.withColumn("half", half).withColumn("votes", F.count("half").over(Window.partitionBy(*PAGE, "half")))
    usual = F.min(F.when(F.col("half").isNotNull(), F.struct((-F.col("votes")).alias("v"), "half"))).over(page)["half"]

    prose = F.col("kind") == "paragraph"
    indent = prose & (x - F.col("edge") > body * 1.3) & (x - up["x"] > body * 1.3)
    ended = prose & (up["wide"] < room * 0.75) & up["text"].rlike(r"[.!?:]\z")
    near = lambda other, distance: (F.abs(x - other) < body) & (distance < body * 1.5)
    address = short & (F.coalesce(near(F.col("next_x"), F.col("ahead")), F.lit(False)) | ((up["wide"] < room * 0.68) & near(up["x"], gap)))
    turn = (F.lag(F.struct("kind", "alignment")).over(seq) != F.struct("kind", "alignment"))
    resized = F.abs(F.col("size") - up["size"]) > body * 0.15
    signs = (up.isNull(), turn, indent, ended, address, resized, F.col("kind") == "signature", F.col("text").rlike(LIST_START))
    ahead = F.when((F.col("ahead") > F.col("size") * 0.8) & (F.col("ahead") < F.col("size") * 2.7), F.col("ahead"))
    d = d.select(
        *PAGE, "line_no", "kind", "alignment", F.coalesce("gap", F.lit(0.0)).alias("gap"), F.exists(F.array(*signs), lambda s: F.coalesce(s, F.lit(False))).alias("opens"),
        F.coalesce(ahead, F.least(F.coalesce(usual, body * 1.2), F.col("size") * 1.2)).alias("pitch"), (body * 1.7).alias("least"))

    def blocks(m) -> list[int]:
        return pagewise.pitch_blocks([r["gap"] for r in m], [r["opens"] for r in m], [r["pitch"] for r in m], m[0]["least"])

    g = _grouped(d, PAGE, ["line_no"])
    z = g.select(*PAGE, F.explode(F.arrays_zip("m", _rows_udf(blocks, "array<int>")("m").alias("b"))).alias("z"))
    return z.select(*PAGE, F.col("z.m.line_no").alias("line_no"), F.col("z.b").alias("block_no"), "z.m.kind", "z.m.alignment")


# Fixed pattern: page number lines.
PAGINATION = r"(?i)^(?:page\s*)?\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?\z"


def select_titles(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, page, table_no, title): the heading right above a table.

    ``regions(doc_id, page, table_no, left, right, top, bottom)``; ``lines(doc_id, page, line_no, text, left,
    right, top, bottom, size, widest_gap)``. At most three closely stacked heading-like lines; a fourth
    tight line, or any doubt, gives no title."""
    table = [*PAGE, "table_no"]
    r = regions.select(*table, *[F.col(c).alias("r_" + c) for c in ("left", "right", "top", "bottom")])
    d = r.join(lines.filter("text <> ''"), PAGE)
    hang = F.greatest(F.lit(6.0), (F.col("r_right") - F.col("r_left")) * 0.15)
    d = d.filter(
        (F.col("bottom") <= F.col("r_top") + 1) & (F.col("left") >= F.col("r_left") - hang) & (F.col("right") <= F.col("r_right") + hang))
    other = r.withColumnRenamed("table_no", "o_no").select(
        *PAGE, "o_no", *[F.col("r_" + c).alias("o_" + c) for c in ("left", "right", "top", "bottom")])
    touching = (
        (d["doc_id"] == other["doc_id"]) & (d["page"] == other["page"]) & (d["table_no"] != other["o_no"])
        & (F.col("left") < F.col("o_right")) & (F.col("right") > F.col("o_left")) & (F.col("top") < F.col("o_bottom")) & (F.col("bottom") > F.col("o_top")))
    d = d.join(other, touching, "left_anti")
    # Only the four nearest lines matter, and the limit is applied before the shuffle.
    near = Window.partitionBy(*table).orderBy(F.desc("top"), F.desc("left"), F.desc("line_no"))
    d = d.withColumn("k", F.row_number().over(near)).filter("k <= 4")
    text = F.col("text")
    heading = (
        (F.length(text) <= 140) & ~text.rlike(PAGINATION) & ~((F.length(text) >= 60) & text.rlike(r"[.!?]\z"))
        & (F.coalesce("widest_gap", F.lit(-1.0)) < F.greatest(F.lit(14.0), F.col("size") * 2.4)))
    m = F.struct("k", text.alias("text"), "top", "bottom", "size", heading.alias("ok"), "r_top")
    g = d.groupBy(*table).agg(F.array_sort(F.collect_list(m)).alias("m"))
    at = lambda i: F.get("m", F.lit(i))
    close = lambda i: (at(i - 1)["top"] - at(i)["bottom"]) <= F.greatest(F.lit(20.0), at(i)["size"] * 1.8)
    has = lambda i: F.size("m") > i
    first = (at(0)["r_top"] - at(0)["bottom"] <= F.greatest(F.lit(36.0), at(0)["size"] * 2.5)) & at(0)["ok"]
    two, three, four = has(1) & close(1), has(2) & close(2), has(3) & close(3)
    bad = ~first | (two & ~at(1)["ok"]) | (two & three & ~at(2)["ok"]) | (two & three & four)
    n = F.when(two & three, 3).when(two, 2).otherwise(1)
    title = F.array_join(F.transform(F.reverse(F.slice("m", F.lit(1), n)), lambda x: x["text"]), "\n")
    return g.select(*table, F.when(~bad & (title != "") & (F.length(title) <= 200), title).alias("title")).filter("title IS NOT NULL")


def margin_key(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"\d+", "#"), "[^a-z#]", "")


def repeated_margin_text(lines: DataFrame, height: Column) -> tuple[DataFrame, DataFrame]:
    """(margin lines with their region, body lines).

    ``lines(doc_id, page, pos, text, y[, bottom])``. Top 9 % and bottom 12 % lines whose folded text is on
    two or more pages of a document leave the body; a lone price line in the footer does too."""
    d = lines.withColumn("h", height).withColumn(
        "region", F.when(F.col("y") < F.col("h") * 0.09, "header").when(F.col("y") > F.col("h") * 0.88, "footer"))
    d = d.withColumn("mkey", margin_key(F.col("text")))
    margin = d.filter("region IS NOT NULL")
    # Distinct first: a line repeated on a million pages is one row per page and partition.
    seen = margin.select("doc_id", "region", "mkey", "page").distinct().groupBy("doc_id", "region", "mkey").agg(F.count("*").alias("pages"))
    key = ["doc_id", "region", "mkey"]
    repeated = margin.join(seen.filter("pages >= 2").select(*key), key, "left_semi")
    price = margin.filter((F.col("region") == "footer") & F.col("text").rlike(r"(?i)^price\s+(?:rs\.?|[$£€])"))
    bottom = F.col("bottom") if "bottom" in lines.columns else F.col("y")
    others = d.select(*PAGE, F.col("pos").alias("o_pos"), bottom.alias("o_bottom"))
    p = price.alias("p").join(others.alias("o"), PAGE).filter(
        (F.col("o_pos") != F.col("pos")) & (F.col("o_bottom") < F.col("y")) & (F.col("y") - F.col("o_bottom") < F.col("h") * 0.08))
    alone = price.join(p.select(*PAGE, "pos"), [*PAGE, "pos"], "left_anti")
    moved = repeated.select(*PAGE, "pos", "region", "text").unionByName(alone.select(*PAGE, "pos", "region", "text")).distinct()
    body = lines.join(moved.select(*PAGE, "pos"), [*PAGE, "pos"], "left_anti")
    return moved, body


def ocr_confidence(words: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by…, words, confidence): mean weighted by characters."""
    weight = F.greatest(F.lit(1), F.length(js_trim("text")))
    return words.groupBy(*by).agg(
        F.count("*").alias("words"), (F.sum(F.col("confidence") * weight) / F.sum(weight)).alias("confidence"))


def strong_pages(words: DataFrame) -> DataFrame:
    """(doc_id, page, confidence, words, lines, strong): mean confidence 65, 12 words, 3 readable lines."""
    alpha = F.regexp_count("text", F.lit("[A-Za-z]{3,}"))
    line = words.groupBy(*PAGE, "line_no").agg(
        F.sum("confidence").alias("c"), F.count("*").alias("n"), F.sum(alpha).alias("a"),
        (F.bool_or(alpha > 0) & (F.max("x1") > F.min("x0")) & (F.max("y1") > F.min("y0"))).alias("readable"))
    d = line.groupBy(*PAGE).agg(
        (F.sum("c") / F.sum("n")).alias("confidence"), F.sum("a").alias("words"), F.sum(F.col("readable").cast("bigint")).alias("lines"))
    return d.withColumn("strong", (F.col("confidence") >= 65) & (F.col("words") >= 12) & (F.col("lines") >= 3))


def best_candidate(candidates: DataFrame, by_words: bool = False) -> DataFrame:
    """(doc_id, page, rotation, score): in try order, a later one wins only by more than 1 (by words: by any more).

    ``candidates(doc_id, page, try_no, rotation, words, confidence)``; a page has four rotations at most."""
    score = F.col("words").cast("double") if by_words else F.least(F.col("words"), F.lit(100)) * F.greatest(F.lit(0.0), F.col("confidence")) / 100
    margin = 0.0 if by_words else 1.0
    tries = F.array_sort(F.collect_list(F.struct("try_no", "rotation", score.alias("score"))))
    g = candidates.groupBy(*PAGE).agg(tries.alias("t"))
    best = F.aggregate(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), F.get("t", F.lit(0)),
                       lambda b, c: F.when(c["score"] > b["score"] + margin, c).otherwise(b))
    return g.select(*PAGE, best.alias("b")).select(*PAGE, "b.rotation", "b.score")


def route_pages(items: DataFrame, limit: int = 25) -> DataFrame:
    """(doc_id, page, characters, table_characters, route, table_route): pages without usable text need recognition."""
    d = items.groupBy(*PAGE).agg(
        F.sum(F.length(F.regexp_replace("text", WS + "+", ""))).alias("characters"), F.sum(F.length(js_trim("text"))).alias("table_characters"))
    table = F.when(F.col("table_characters") >= limit, "native").when(F.col("table_characters") > 0, "native-then-ocr").otherwise("ocr")
    return d.withColumns({"route": F.when(F.col("characters") < limit, "ocr").otherwise("native"), "table_route": table})


def _centre(d: DataFrame) -> DataFrame:
    a, w, h = F.radians("angle"), F.col("width") / 2, F.col("height") / 2
    return d.withColumns({
        "__cx": F.col("x") + F.cos(a) * w - F.sin(a) * h, "__cy": F.col("y") + F.sin(a) * w + F.cos(a) * h,
        "__token": search_token("text"),
    })


#: Squares in which the words of a token meet on pages where new and existing ones make more than ``CROWD`` pairs.
SQUARE_POINTS, CROWD = 256, 1024


def _lies_on(other: Column) -> tuple[Column, Column]:
    """Whether a word of the other layer with the same token lies on this one, and how far their centres are apart."""
    ratio = lambda c: F.greatest(F.col(c), other[c]) / F.greatest(F.lit(1.0), F.least(F.col(c), other[c]))
    far = F.hypot(F.col("__cx") - other["__cx"], F.col("__cy") - other["__cy"])
    limit = F.greatest(F.lit(10.0), F.col("height") * 1.6, other["height"] * 1.6, F.least(F.col("width"), other["width"]) * 0.3)
    turn = F.abs(F.pmod(F.col("angle") - other["angle"] + 90, F.lit(180.0)) - 90)
    return (far <= limit) & (ratio("width") <= 4) & (ratio("height") <= 4) & (turn <= 20), far


def _loses(options: Column) -> Column:
    """Whether a hidden word finds no free place when each, in turn, takes the nearest free one of its own.

    ``options`` are (e_no, distance, word_no) in order."""
    none = F.struct(F.lit(None).cast("bigint").alias("e_no"), F.lit(True).alias("served"), F.array().cast("array<bigint>").alias("taken"), F.lit(False).alias("lost"))

    def step(acc: Column, o: Column) -> Column:
        e, w = o["e_no"].cast("bigint"), o["word_no"].cast("bigint")
        same = F.coalesce(acc["e_no"] == e, F.lit(False))
        takes = ~(same & acc["served"]) & ~F.array_contains(acc["taken"], w)
        return F.struct(
            e.alias("e_no"), (takes | (same & acc["served"])).alias("served"), F.when(takes, F.concat(acc["taken"], F.array(w))).otherwise(acc["taken"]).alias("taken"),
            (acc["lost"] | (~same & ~acc["served"])).alias("lost"))

    return F.aggregate(options, none, step, lambda acc: acc["lost"] | ~acc["served"])


#: What a row of two met layers is.
FRESH, VISIBLE, HIDDEN, ODD = range(4)


def _met_layers(new: DataFrame, existing: DataFrame, sheets: DataFrame, how: str) -> DataFrame:
    """The words of both layers, new ones with all their columns, joined with ``sheets(doc_id, page, __pw, __ph)``.

    ``__kind`` tells new words from existing ones, among these hidden ones, in a plausible place or not. ``__shown`` and
    ``__veiled`` tell of a new word whether a visible and a hidden one lie on it, ``__bad`` of a page's rows whether its hidden
    layer is unreliable. The only shuffle is by page; words of a token meet in windows there. Heights differ by four times
    at most, so an existing word bounds how far a partner can be; where a token makes many pairs, it is listed in each
    grid square within that reach and new words look into their own. Rows are kept narrow, as they are sorted twice."""
    kind = F.col("__kind")
    fresh, hidden = kind == FRESH, kind >= HIDDEN
    old = _centre(existing).filter("__token <> ''").select(
        *PAGE, "word_no", "angle", "width", "height", "__token", "__cx", "__cy", F.when(F.col("hidden"), HIDDEN).otherwise(VISIBLE).alias("__kind"))
    d = _centre(new).withColumn("__kind", F.lit(FRESH)).unionByName(old, allowMissingColumns=True).join(sheets.hint("shuffle_hash"), PAGE, how)
    plausible = (
        (F.col("width") > 0) & (F.col("height") > 0) & (F.col("width") < F.col("__pw") * 1.25) & (F.col("height") < F.col("__ph") * 0.25)
        & F.col("__cx").between(-4, F.col("__pw") + 4) & F.col("__cy").between(-4, F.col("__ph") + 4))
    d = d.withColumn("__kind", F.when(hidden & ~plausible, ODD).otherwise(kind)).drop("__pw", "__ph")

    words = Window.partitionBy(*PAGE, "__token")
    count = lambda c: F.sum(c.cast("bigint")).over(words)
    cell = lambda c: F.floor(c / SQUARE_POINTS).cast("bigint")
    square = lambda x, y: F.shiftleft(x, 32) + y
    reach = F.greatest(F.lit(10.0), F.col("height") * 6.4, F.col("width") * 0.3)
    near = lambda c: F.sequence(cell(F.col(c) - reach), cell(F.col(c) + reach))
    squares = (
        F.when(count(fresh) * count(~fresh) <= CROWD, F.array(F.lit(0).cast("bigint"))).when(fresh, F.array(square(cell(F.col("__cx")), cell(F.col("__cy")))))
        .otherwise(F.flatten(F.transform(near("__cx"), lambda x: F.transform(near("__cy"), lambda y: square(x, y))))))
    d = d.withColumn("__squares", squares).select("*", F.posexplode_outer("__squares").alias("__copy", "__square")).drop("__squares")

    spot = Window.partitionBy(*PAGE, "__token", "__square")
    listed = lambda which: F.collect_list(F.when(which, F.struct("word_no", "angle", "width", "height", "__cx", "__cy", hidden.alias("hidden")))).over(spot)
    d = d.withColumns({"__new": listed(fresh), "__old": listed(~fresh)})
    lies = lambda o: F.coalesce(_lies_on(o)[0], F.lit(False))
    option = lambda o: F.struct(F.col("word_no").alias("e_no"), _lies_on(o)[1].alias("distance"), o["word_no"].alias("word_no"))
    d = d.withColumns({
        "__shown": fresh & F.exists("__old", lambda o: ~o["hidden"] & lies(o)), "__veiled": fresh & F.exists("__old", lambda o: o["hidden"] & lies(o)),
        "__options": F.when(hidden, F.transform(F.filter("__new", lies), option))}).drop("__new", "__old")

    # Hidden words take the nearest free place in their listed order; one word of a token looks for all of them.
    d = d.withColumns({
        "__n": count(fresh), "__h": count(hidden & (F.coalesce("__copy", F.lit(0)) == 0)), "__first": F.min(F.when(hidden, F.col("word_no"))).over(words),
        "__options": F.flatten(F.collect_list("__options").over(words))})
    d = d.withColumn("__options", F.when(hidden & (F.col("word_no") == F.col("__first")), F.sort_array("__options")))
    each = lambda c: F.size(F.array_distinct(F.transform("__options", lambda o: o[c])))
    contested = (F.col("__h") > 1) & (each("word_no") < F.size("__options"))
    lost = F.col("__options").isNotNull() & (F.col("__n") > 0) & ((each("e_no") < F.col("__h")) | F.when(contested, _loses(F.col("__options"))).otherwise(False))
    bad = (kind == ODD) | F.coalesce(lost, F.lit(False))
    return d.withColumn("__bad", bad).withColumn("__bad", F.max("__bad").over(Window.partitionBy(*PAGE)))


def _sheets(pages: DataFrame) -> DataFrame:
    return pages.groupBy(*PAGE).agg(F.min("width").alias("__pw"), F.min("height").alias("__ph"))


def hidden_layer_unreliable(new: DataFrame, existing: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page) where the hidden layer cannot be trusted: a hidden word is off any plausible place, or
    its token was recognised on the page but no free occurrence lies on it.

    Hidden words take the nearest free occurrence in their listed order, token by token. New words of pages without
    a hidden word leave in the shuffle by page."""
    hidden = existing.filter("hidden")
    sheets = hidden.select(*PAGE).distinct().join(_sheets(pages).hint("shuffle_hash"), PAGE, "left")
    return _met_layers(new, hidden, sheets, "inner").filter("__bad").select(*PAGE).distinct()


def dedupe_text_layer(new: DataFrame, existing: DataFrame, pages: DataFrame) -> DataFrame:
    """New words that no kept existing word repeats; an unreliable hidden layer is not kept."""
    d = _met_layers(new, existing, _sheets(pages), "left")
    return d.filter((F.col("__kind") == FRESH) & ~F.col("__shown") & (F.col("__bad") | ~F.col("__veiled"))).select(*new.columns)
