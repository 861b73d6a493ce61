"""Checks on extracted tables in long form.

``cells(table_id, row, col, text)``; typed cells add ``num DECIMAL(38,15)`` (NULL when textual).
``merges(table_id, merge_no, start_row, end_row, start_col, end_col)``;
``evidence(table_id, row, col, …)``; ``headers(table_id, header_rows)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sheaf.functions import ordered
from sheaf.functions.numbers import identifier_heading, numeric_literal, plain_number
from sheaf.functions.stabbing import covering
from sheaf.functions.text import WS, is_blank, js_trim
from sheaf.session import stage

CELL = ["table_id", "row", "col"]
# Fixed patterns.
DATE_CELL = r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b"
NUMERIC_CELL = r"^-?\d[\d,.]*$"


def explode_cells(rows: DataFrame) -> DataFrame:
    """(table_id, row, cells ARRAY) to one row per coordinate."""
    return rows.select("table_id", "row", F.posexplode("cells").alias("col", "text"))


def _at_anchor() -> Column:
    return (F.col("row") == F.col("start_row")) & (F.col("col") == F.col("start_col"))


def _well_formed(merges: DataFrame) -> DataFrame:
    return merges.filter("start_row >= 0 AND start_col >= 0 AND start_row <= end_row AND start_col <= end_col")


def covered_cells(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """The cells that lie in merges, one row per cell and merge, with ``anchor``: whether the cell is the merge's first.

    A merge costs a few rows, however many coordinates it spans; cells that don't exist give none."""
    return covering(cells, merges, ["table_id"]).withColumn("anchor", _at_anchor())


#: A table with more merges than this finds its cells' merges by stretches of rows instead of looking through them.
FEW_MERGES = 64


def _areas(merges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """((table_id, areas ARRAY by merge_no) of tables with few well-formed merges, the tables with many or None)."""
    formed = _well_formed(merges)
    crowded = formed.groupBy("table_id").count().filter(F.col("count") > FEW_MERGES).select("table_id")
    if crowded.isEmpty():
        crowded = None
    else:
        crowded = stage(crowded)
        formed = formed.join(crowded, "table_id", "left_anti")
    area = F.struct("merge_no", "start_row", "end_row", "start_col", "end_col")
    return formed.groupBy("table_id").agg(F.array_sort(F.collect_list(area)).alias("areas")), crowded


def _covers(area: Column) -> Column:
    row, col = F.col("row"), F.col("col")
    return (area["start_row"] <= row) & (area["end_row"] >= row) & (area["start_col"] <= col) & (area["end_col"] >= col)


def _flag_subordinates(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Add ``subordinate``. The merges of a table meet its cells by table, which later steps by table, row or column keep."""
    areas, crowded = _areas(merges)
    below = lambda a: _covers(a) & ~((a["start_row"] == F.col("row")) & (a["start_col"] == F.col("col")))
    few = cells.join(areas, "table_id", "left").select(
        *cells.columns, F.coalesce(F.exists("areas", below), F.lit(False)).alias("subordinate"))
    if crowded is None:
        return few
    many = cells.join(crowded, "table_id", "left_semi")
    sub = covered_cells(many.select(*CELL), _well_formed(merges)).filter("NOT anchor").select(*CELL).distinct()
    flagged = many.join(sub.withColumn("subordinate", F.lit(True)), CELL, "left")
    flagged = flagged.withColumn("subordinate", F.coalesce("subordinate", F.lit(False)))
    return few.join(crowded, "table_id", "left_anti").unionByName(flagged)


def column_headings(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(table_id, col, heading): header rows of a column joined by blanks."""
    h = cells.join(headers, "table_id").filter("row < header_rows")
    words = F.array_sort(F.collect_list(F.struct("row", "text")))
    return h.groupBy("table_id", "col").agg(F.array_join(F.transform(words, lambda x: x["text"]), " ").alias("heading"))


def conservative_cast(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Add ``num``: complete unambiguous numbers outside identifier columns; everything else stays text."""
    # The heading is judged once per column. Cells below every header don't take part in it, and identifier columns
    # meet the cells by table, which later steps by table, row or column keep.
    deepest = headers.agg(F.max("header_rows")).first()[0]
    pinned = column_headings(cells.filter(F.col("row") < F.lit(deepest)), headers).filter(identifier_heading("heading"))
    pinned = pinned.groupBy("table_id").agg(F.collect_set("col").alias("pinned"))
    d = cells.join(pinned, "table_id", "left")
    free = ~F.coalesce(F.array_contains("pinned", F.col("col")), F.lit(False))
    return d.select(*cells.columns, F.when(free, numeric_literal("text")).alias("num"))


def column_type_profile(typed: DataFrame, headers: DataFrame) -> DataFrame:
    """(table_id, col, cells, numeric, share) over the non-empty body cells."""
    body = typed.join(headers, "table_id").filter("row >= header_rows").filter(~is_blank("text"))
    return body.groupBy("table_id", "col").agg(
        F.count("*").alias("cells"), F.count("num").alias("numeric"),
        (F.count("num") / F.count("*")).alias("share"),
    )


def infer_date_columns(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(table_id, col, dates, filled): at least two date-like cells and 30 % of the filled body cells."""
    body = cells.join(headers, "table_id").filter("row >= header_rows AND text <> ''")
    d = body.groupBy("table_id", "col").agg(
        F.sum(F.col("text").rlike(DATE_CELL).cast("bigint")).alias("dates"), F.count("*").alias("filled")
    )
    return d.filter((F.col("dates") >= 2) & (F.col("dates") >= F.col("filled") * 0.3))


def infer_header_rows(cells: DataFrame, scanned: bool = False) -> DataFrame:
    """(table_id, header_rows)."""
    if scanned:
        first = cells.groupBy("table_id").agg(
            F.sum(((F.col("row") == 0) & F.col("text").rlike(r"\d")).cast("int")).alias("digits"),
            F.sum(((F.col("row") == 0) & F.col("text").rlike("[A-Za-z]{2,}")).cast("int")).alias("words"),
        )
        return first.select("table_id", F.when((F.col("digits") <= 1) & (F.col("words") >= 2), 1).otherwise(0).alias("header_rows"))
    per_row = cells.groupBy("table_id", "row").agg(
        F.sum(js_trim("text").rlike(NUMERIC_CELL).cast("int")).alias("numeric")
    )
    d = per_row.groupBy("table_id").agg(
        F.min(F.when((F.col("row") > 0) & (F.col("numeric") >= 2), F.col("row"))).alias("data_row")
    )
    return d.select("table_id", F.coalesce(F.least("data_row", F.lit(4)), F.lit(1)).cast("int").alias("header_rows"))


def lineage_coverage(cells: DataFrame, evidence: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per-table coverage, cells without evidence)."""
    filled = cells.filter(~is_blank("text")).select(*CELL, "text", F.lit(False).alias("found"))
    found = evidence.select(*CELL, F.lit(None).cast("string").alias("text"), F.lit(True).alias("found"))
    # One shuffle by table: a cell and its evidence meet in a window, and so do the merges of its table.
    d = filled.unionByName(found).repartition("table_id")
    d = d.withColumn("backed", F.max("found").over(Window.partitionBy(*CELL))).filter("NOT found").drop("found")
    d = _flag_subordinates(d, merges)
    backed = F.col("backed")
    missing = ~F.col("subordinate") & ~backed
    n = lambda c: F.sum(c.cast("bigint"))
    per_table = d.groupBy("table_id").agg(
        F.count("*").alias("non_empty"), n(~F.col("subordinate") & backed).alias("backed"),
        n(F.col("subordinate")).alias("excluded"), n(missing).alias("missing"),
    )
    status = F.when(F.col("missing") > 0, "NEEDS_REVIEW").otherwise("PASS")
    return per_table.withColumn("status", status), d.filter(missing).select(*CELL, "text")


def diff_tables(original: DataFrame, current: DataFrame) -> DataFrame:
    """Changed, added and removed cells of typed tables: (table_id, row, col, before, after, kind).

    A number differs from a text of the same look."""
    value = F.struct(F.col("num").isNotNull().alias("n"), F.coalesce(plain_number("num"), F.col("text")).alias("v"))
    a = original.select(*CELL, value.alias("a"))
    b = current.select(*CELL, value.alias("b"))
    d = a.join(b, CELL, "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return d.select(*CELL, F.col("a.v").alias("before"), F.col("b.v").alias("after"), kind.alias("kind"))


def total_label(text: Column | str) -> Column:
    t = F.regexp_replace(F.lower(js_trim(text)), WS + "+", " ")
    t = js_trim(F.regexp_replace(t, r":\z", ""))
    # Every label holds this word, so other texts are not normalised.
    possible = F.lower(text if isinstance(text, Column) else F.col(text)).contains("total")
    return F.when(
        possible,
        F.when(t == "grand total", "grand-total").when(t == "net total", "net-total")
        .when(t.isin("subtotal", "sub total"), "subtotal").when(t == "total", "total")
    )


def _kinds() -> Column:
    return F.array(*[F.lit(k) for k in ("grand-total", "net-total", "subtotal", "total")])


def _labelled(typed: DataFrame, merges: DataFrame) -> DataFrame:
    d = _flag_subordinates(typed, merges).filter("NOT subordinate").drop("subordinate")
    return d.withColumn("label", F.when(F.col("num").isNull(), total_label("text")))


def _total_rows(labelled: DataFrame) -> DataFrame:
    rows = labelled.groupBy("table_id", "row").agg(
        F.count("label").alias("labels"), F.max("label").alias("label"),
        F.max(F.when(F.col("label").isNotNull(), F.col("col"))).alias("label_col"), F.count("num").alias("n_targets"),
    )
    return rows.filter("labels = 1 AND n_targets > 0").drop("labels")


def find_total_rows(typed: DataFrame, merges: DataFrame) -> DataFrame:
    """(table_id, row, label, label_col, n_targets): rows with exactly one label and a numeric target."""
    return _total_rows(_labelled(typed, merges))


def reconcile_totals(typed: DataFrame, merges: DataFrame, headers: DataFrame) -> DataFrame:
    """One row per total target: (table_id, row, col, label, status, actual, expected, difference,
    contributors, skip_reason).

    Contributors are the numeric cells of the column since the preceding total row (or the header). Cells
    stream through windows in the order of their table, so no pair of rows is ever joined; a column's sections
    hold one target each, and grand totals run over the sections before theirs."""
    d = _labelled(typed, merges).join(headers, "table_id")
    line = Window.partitionBy("table_id", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumns({
        "labels": F.count("label").over(line), "n_targets": F.count("num").over(line),
        "kind": F.max(F.array_position(_kinds(), F.col("label")).cast("int")).over(line),
        "label_col": F.max(F.when(F.col("label").isNotNull(), F.col("col"))).over(line)})
    total = (F.col("labels") == 1) & (F.col("n_targets") > 0)
    # A total row ends the section it is in, whatever the column of its label.
    at_label = total & (F.col("col") == F.col("label_col"))
    so_far = Window.partitionBy("table_id").orderBy("row", "col").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.sum(at_label.cast("bigint")).over(so_far)
    d = d.withColumn("section", opened - F.when(total & (F.col("col") >= F.col("label_col")), 1).otherwise(0))
    content = ~total & (F.col("row") >= F.col("header_rows")) & ~is_blank("text")
    target = total & F.col("num").isNotNull() & (F.col("col") != F.col("label_col"))
    s = d.groupBy("table_id", "col", "section").agg(
        F.try_sum(F.when(content, F.col("num"))).alias("own"), F.count(F.when(content, F.col("num"))).alias("own_n"),
        F.coalesce(F.bool_or(content & F.col("num").isNull()), F.lit(False)).alias("contaminated"),
        F.sum((~is_blank("text")).cast("bigint")).alias("filled"),
        F.max(F.when(target, F.col("row"))).alias("row"), F.max(F.when(target, F.col("kind"))).alias("kind"),
        F.max(F.when(target, F.col("num"))).alias("actual"),
    )
    own_reason = F.when(F.col("contaminated"), AMBIGUOUS_CONTENT).when(F.col("own_n") < 2, TOO_FEW)
    s = s.withColumns({"label": F.get(_kinds(), F.col("kind") - 1), "own_reason": own_reason})
    prior = F.coalesce(F.col("label").isin("subtotal", "total"), F.lit(False))
    column = Window.partitionBy("table_id", "col").orderBy("section")
    before = column.rowsBetween(Window.unboundedPreceding, -1)
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")).over(before), F.lit(0).cast("bigint"))
    s = s.withColumn("filled", F.sum("filled").over(column.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumns({
        "n": n(prior), "n_sub": n(F.coalesce(F.col("label") == "subtotal", F.lit(False))), "n_na": n(prior & F.col("own_reason").isNotNull()),
        "above": F.sum(F.when(prior, F.col("actual"))).over(before), "last_filled": F.max(F.when(prior, F.col("filled"))).over(before),
    }).filter("label IS NOT NULL")
    # The grand total cell itself is filled, so nothing trails when exactly one cell was added.
    ambiguous = (
        (F.col("n") == 0) | ((F.col("n_sub") > 0) & (F.col("n_sub") < F.col("n"))) | (F.col("n_na") > 0)
        | (F.col("filled") - F.col("last_filled") > 1)
    )
    grand = F.col("label") == "grand-total"
    s = s.withColumns({
        "contributors": F.when(grand, F.col("n") - F.col("n_na")).otherwise(F.col("own_n")),
        "expected": F.when(grand, F.col("above").cast("decimal(38,15)")).otherwise(F.col("own").cast("decimal(38,15)")),
    })
    grand_reason = F.when(ambiguous, "ambiguous-grand-total-structure").when(F.col("contributors") < 2, TOO_FEW)
    return _verdict(s, F.when(grand, grand_reason).otherwise(F.col("own_reason")))


AMBIGUOUS_CONTENT, TOO_FEW = "ambiguous-non-numeric-content", "fewer-than-two-contributors"
TOTAL_COLUMNS = [
    "table_id", "row", "col", "label", "status", "actual", "expected", "difference", "contributors", "skip_reason",
]


def _verdict(t: DataFrame, reason: Column) -> DataFrame:
    d = t.withColumn("skip_reason", reason)
    skipped = F.col("skip_reason").isNotNull()
    d = d.withColumn("difference", F.when(~skipped, F.col("actual") - F.col("expected")))
    status = (
        F.when(skipped, "NOT_APPLICABLE").when(F.col("difference") == 0, "PASS").otherwise("NEEDS_REVIEW")
    )
    d = d.withColumn("status", status).withColumn("expected", F.when(~skipped, F.col("expected")))
    return d.select(*TOTAL_COLUMNS)


def verification_summary(coverage: DataFrame, edits: DataFrame, totals: DataFrame) -> DataFrame:
    """Six counters per table."""
    n = lambda c: F.sum(c.cast("bigint"))
    e = edits.groupBy("table_id").agg(F.count("*").alias("edited_cells"))
    t = totals.groupBy("table_id").agg(
        n(F.col("status") != "NOT_APPLICABLE").alias("applicable_totals"),
        n(F.col("status") == "PASS").alias("passed_totals"), n(F.col("status") == "NEEDS_REVIEW").alias("totals_to_review"),
    )
    d = coverage.select("table_id", F.col("backed").alias("source_linked"), F.col("missing").alias("missing_source"))
    d = d.join(e, "table_id", "full_outer").join(t, "table_id", "full_outer")
    return d.na.fill(0)


def stitch_continuations(fragments: DataFrame, *, layout: bool = False) -> DataFrame:
    """Add ``stitched`` (number of the joined table in its document) and ``row_offset``.

    ``fragments(doc_id, ordinal, page, n_cols, n_rows, first_key, last_key, top, bottom, edges)`` with
    ``edges ARRAY<DOUBLE>`` relative to the page. A fragment continues its predecessor on the next page
    when keys run on and geometry agrees. Ruled tables compare edges with the first fragment of the
    chain; layout tables with the neighbour, under tighter limits."""
    low, high, tolerance = (0.78, 0.18, 0.008) if layout else (0.9, 0.1, 0.02)
    near = lambda a, b: (F.size(a) == F.size(b)) & F.forall(
        F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda v: (v < tolerance) if layout else (v <= tolerance))
    values = ["page", "n_cols", "last_key", "bottom", "edges", "first_key", "top"]

    def neighbours(cur, prev) -> Column:
        joined = (
            (prev("page") + 1 == cur("page")) & (prev("n_cols") == cur("n_cols"))
            & (prev("last_key") + 1 == cur("first_key")) & (cur("top") <= high)
        )
        if layout:
            joined = joined & (prev("bottom") >= low) & near(prev("edges"), cur("edges"))
        return joined

    key = ["doc_id"]
    if layout:
        d = ordered.with_previous(fragments, key, ["ordinal"], values, starts=lambda c, p: ~neighbours(c, p), island="stitched")
    else:
        d = _chains(stage(fragments), values, neighbours, near, low)
    return ordered.running(
        d.drop("prev"), ["doc_id", "stitched"], ["ordinal"], {"row_offset": F.col("n_rows")}, inclusive=False
    )


def _chains(fragments, values, neighbours, near, low) -> DataFrame:
    """Chains against their first fragment. Runs of neighbours are found once. Each round cuts every open chain at its first
    failing link and goes on with what follows the cut, so rounds are as many as the most cuts in one run and only the
    first reads all fragments."""
    opens = lambda c, p: ~neighbours(c, p)
    d = ordered.with_previous(fragments, ["doc_id"], ["ordinal"], [*values, "ordinal"], starts=opens, island="run")
    opened = F.coalesce(opens(lambda n: F.col(n), lambda n: F.col("prev")[n]), F.lit(True))
    d = stage(d.withColumns({"opened": opened, "before": F.col("prev.ordinal")}).drop("prev"))
    link = ["doc_id", "run"]
    first = F.struct("ordinal", "edges", "bottom").alias("f")
    rows = d.select(*link, "ordinal", "before", "edges", "bottom", "opened")
    cuts = None
    while True:
        j = rows.filter("NOT opened").join(rows.filter("opened").select(*link, first), link)
        second = F.col("before") == F.col("f.ordinal")
        fails = ~near(F.col("f.edges"), F.col("edges")) | (second & (F.col("f.bottom") < low))
        new = stage(j.filter(fails).groupBy(*link).agg(F.min("ordinal").alias("cut")))
        if new.isEmpty():
            break
        cuts = new if cuts is None else cuts.unionByName(new)
        rest = rows.join(new, link).filter(F.col("ordinal") >= F.col("cut"))
        rows = stage(rest.withColumn("opened", F.col("ordinal") == F.col("cut")).drop("cut"))
    if cuts is None:
        return d.withColumnRenamed("run", "stitched").drop("opened", "before")
    # A mark before the row of each cut: the marks so far count the chains that cuts have added.
    d = d.drop("opened", "before").withColumn("mark", F.lit(0).cast("bigint"))
    marks = cuts.select("doc_id", F.col("cut").alias("ordinal"), F.lit(1).cast("bigint").alias("mark"))
    d = d.unionByName(marks, allowMissingColumns=True).withColumn("place", -F.col("mark"))
    d = ordered.running(d, ["doc_id"], ["ordinal", "place"], {"added": F.col("mark")}).filter("mark = 0")
    return d.withColumn("stitched", F.col("run") + F.col("added")).drop("run", "added", "mark", "place")


def plan_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """(table_id, merge_no, outcome applied / skipped): merges in listed order, first come first served.

    Repeats and 1×1 regions are left out."""
    shape = ["start_row", "end_row", "start_col", "end_col"]
    formed = (
        (F.col("start_row") >= 0) & (F.col("start_col") >= 0)
        & (F.col("start_row") <= F.col("end_row")) & (F.col("start_col") <= F.col("end_col"))
    )
    merges = stage(merges.select("table_id", "merge_no", *shape))
    malformed = merges.filter(~formed).select("table_id", "merge_no", F.lit("skipped").alias("outcome"))
    formed = merges.filter(formed)
    crowded = formed.groupBy("table_id").agg(F.count("*").alias("n"), F.count_distinct("merge_no").alias("ids"))
    crowded = stage(crowded.filter((F.col("n") > FEW_MERGES) | (F.col("ids") < F.col("n"))).select("table_id"))
    if crowded.isEmpty():
        return malformed.unionByName(_planned_by_table(cells, formed))
    few, many = (lambda d: d.join(crowded, "table_id", "left_anti")), (lambda d: d.join(crowded, "table_id", "left_semi"))
    return malformed.unionByName(_planned_by_table(cells, few(formed))).unionByName(_planned_in_rounds(many(cells), many(formed)))


def _planned_by_table(cells: DataFrame, formed: DataFrame) -> DataFrame:
    """Tables of few merges: cells meet the merges of their table in one shuffle, and conflicts are settled in listed order.

    Only whole merges compete, so that they share a cell exactly if their rectangles overlap."""
    shape = ["start_row", "end_row", "start_col", "end_col"]
    areas = formed.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("merge_no", *shape))).alias("areas"))
    alike = lambda a, b: (a["start_row"] == b["start_row"]) & (a["end_row"] == b["end_row"]) & (a["start_col"] == b["start_col"]) & (a["end_col"] == b["end_col"])
    single = lambda a: (a["start_row"] == a["end_row"]) & (a["start_col"] == a["end_col"])
    areas = areas.select("table_id", F.filter("areas", lambda a, i: ~single(a) & ~F.exists(F.slice("areas", 1, i), lambda b: alike(a, b))).alias("areas"))
    # What a cell's text says, not the text itself, goes to its table.
    state = cells.select(*CELL, F.when(F.col("text").isNotNull(), is_blank("text")).alias("blank"))
    d = state.join(areas.filter(F.size("areas") > 0).hint("shuffle_hash"), "table_id", "right")
    d = d.select("table_id", "areas", "row", "col", "blank", F.explode_outer(F.filter("areas", _covers)).alias("m"))
    anchor = (F.col("m.start_row") == F.col("row")) & (F.col("m.start_col") == F.col("col"))
    d = d.select("table_id", "areas", "row", "col", F.col("m.merge_no").alias("merge_no"), F.col("blank").isNotNull().cast("bigint").alias("held"),
                 (F.col("blank").isNull() | ~anchor & ~F.col("blank")).alias("bad"))
    # Merges are few a table and their cells many, so areas ride along only as far as the first of the two sums.
    d = d.groupBy("table_id", "merge_no", "row", "col").agg(F.first("areas").alias("areas"), F.max("held").alias("held"), F.bool_or("bad").alias("bad"))
    d = d.groupBy("table_id", "merge_no").agg(F.first("areas").alias("areas"), F.sum("held").alias("held"), F.bool_or("bad").alias("bad"))
    whole = F.filter(F.collect_list(F.when(~F.col("bad"), F.struct("merge_no", "held"))), lambda x: x["merge_no"].isNotNull())
    d = d.groupBy("table_id").agg(F.first("areas").alias("areas"), whole.alias("whole"))
    size = lambda a: (a["end_row"] - a["start_row"] + 1).cast("double") * (a["end_col"] - a["start_col"] + 1)
    d = d.withColumn("open", F.filter("areas", lambda a: F.exists("whole", lambda w: (w["merge_no"] == a["merge_no"]) & (w["held"] >= size(a)))))
    meet = lambda a, b: ((a["start_row"] <= b["end_row"]) & (b["start_row"] <= a["end_row"]) & (a["start_col"] <= b["end_col"]) & (b["start_col"] <= a["end_col"]))
    none = F.filter("open", lambda a: F.lit(False))
    applied = F.aggregate("open", none, lambda acc, a: F.when(F.exists(acc, lambda b: meet(a, b)), acc).otherwise(F.concat(acc, F.array(a))))
    d = d.withColumn("applied", F.transform(applied, lambda a: a["merge_no"]))
    outcome = lambda a: F.when(F.array_contains("applied", a["merge_no"]), "applied").otherwise("skipped")
    return d.select("table_id", F.inline(F.transform("areas", lambda a: F.struct(a["merge_no"].alias("merge_no"), outcome(a).alias("outcome")))))


def _planned_in_rounds(cells: DataFrame, formed: DataFrame) -> DataFrame:
    """The same for tables of many merges, by stretches of rows. Conflicts resolve in rounds: a merge that is first in all
    its cells is applied, whatever touches it is skipped, until none is open."""
    shape = ["start_row", "end_row", "start_col", "end_col"]
    unique = formed.groupBy("table_id", *shape).agg(F.min("merge_no").alias("merge_no"))
    unique = unique.filter("start_row <> end_row OR start_col <> end_col")
    merge = ["table_id", "merge_no"]
    covered = stage(covered_cells(cells.select(*CELL, "text"), unique).select(*merge, "row", "col", "anchor", "text"))
    state = covered.groupBy(*merge).agg(
        F.count_distinct(F.when(F.col("text").isNotNull(), F.struct("row", "col"))).alias("held"),
        F.bool_or(F.col("text").isNull() | ~F.col("anchor") & ~is_blank("text")).alias("bad"))
    # a merge is whole if it covers as many cells as it has coordinates
    area = (F.col("end_row") - F.col("start_row") + 1).cast("double") * (F.col("end_col") - F.col("start_col") + 1)
    state = unique.select(*merge, area.alias("area")).join(state, merge, "left").withColumn(
        "bad", F.coalesce("bad", F.lit(True)) | (F.col("held") < F.col("area")))
    rejected = state.filter("bad").select(*merge)
    open_cells = stage(covered.join(state.filter("NOT bad").select(*merge), merge, "left_semi").select(*merge, "row", "col").distinct())
    skipped = rejected
    applied = None
    while True:
        first = open_cells.groupBy(*CELL).agg(F.min("merge_no").alias("first"))
        ranked = open_cells.join(first, CELL).groupBy(*merge).agg(F.bool_and(F.col("first") == F.col("merge_no")).alias("wins"))
        wins = stage(ranked.filter("wins").select(*merge))
        applied = wins if applied is None else applied.unionByName(wins)
        taken = open_cells.join(wins, merge, "left_semi").select(*CELL)
        rest = open_cells.join(wins, merge, "left_anti")
        lost = stage(rest.join(taken, CELL, "left_semi").select(*merge).distinct())
        skipped = skipped.unionByName(lost)
        open_cells = stage(rest.join(lost, merge, "left_anti"))
        if open_cells.isEmpty():
            break
    return applied.withColumn("outcome", F.lit("applied")).unionByName(skipped.withColumn("outcome", F.lit("skipped")))


def trace_cell(cells: DataFrame, evidence: DataFrame, merges: DataFrame, selections: DataFrame) -> DataFrame:
    """Selected coordinates with their evidence: (…, source_text, page, notice, anchor_row, anchor_col).

    A cell shows its own evidence, else the evidence of the merge that covers it, else a notice."""
    areas, crowded = _areas(merges)
    if crowded is None:
        return _traced_by_table(cells, evidence, areas, selections)
    many = lambda d: d.join(crowded, "table_id", "left_semi")
    few = _traced_by_table(cells, evidence, areas, selections.join(crowded, "table_id", "left_anti"))
    return few.unionByName(_traced_by_stretches(many(cells), many(evidence), many(merges), many(selections)))


def _traced_by_table(cells: DataFrame, evidence: DataFrame, areas: DataFrame, selections: DataFrame) -> DataFrame:
    """In one shuffle by table: windows bring selections, texts and evidence of a coordinate together, then covered
    selections and the evidence at their merge's first cell."""
    none = lambda kind: F.lit(None).cast(kind)
    seen = F.struct(evidence["page"], evidence["source_text"])
    kind = evidence.select(seen.alias("e")).schema["e"].dataType
    part = lambda d, what, text, e: d.select(*CELL, F.lit(what).alias("what"), text.alias("text"), e.alias("e"))
    d = part(selections, 0, none("string"), none(kind)).unionByName(part(cells, 1, F.col("text"), none(kind))).unionByName(
        part(evidence, 2, none("string"), seen)).repartition("table_id")
    at = Window.partitionBy(*CELL)
    d = d.withColumns({"text": F.max("text").over(at), "own": F.max((F.col("what") == 2).cast("int")).over(at) == 1})
    d = d.filter("what <> 1").join(areas, "table_id", "left").withColumn("m", F.get(F.filter("areas", _covers), F.lit(0))).drop("areas")
    first = (F.col("m.start_row") == F.col("row")) & (F.col("m.start_col") == F.col("col"))
    inner = (F.col("what") == 0) & ~F.col("own") & F.col("m").isNotNull() & ~first
    d = d.withColumns({"anchor_row": F.when(inner, F.col("m.start_row")), "anchor_col": F.when(inner, F.col("m.start_col"))})
    d = d.withColumns({"look_row": F.coalesce("anchor_row", "row"), "look_col": F.coalesce("anchor_col", "col")})
    d = d.withColumn("found", F.collect_list("e").over(Window.partitionBy("table_id", "look_row", "look_col"))).filter("what = 0")
    notice = (
        F.when(F.col("own"), "none").when(F.col("anchor_row").isNotNull(), "merged-subordinate")
        .when(F.col("text").isNotNull() & is_blank("text"), "empty-cell").otherwise("no-source-location")
    )
    d = d.select(*CELL, notice.alias("notice"), "anchor_row", "anchor_col", F.explode_outer("found").alias("e"))
    return d.select(*CELL, "notice", "anchor_row", "anchor_col", "e.page", "e.source_text")


def _traced_by_stretches(cells: DataFrame, evidence: DataFrame, merges: DataFrame, selections: DataFrame) -> DataFrame:
    """The same for tables of many merges."""
    e = evidence.select(*CELL, "page", "source_text")
    areas = covered_cells(selections.select(*CELL).distinct(), _well_formed(merges))
    cover = areas.groupBy(*CELL).agg(F.min_by(F.struct("start_row", "start_col"), "merge_no").alias("m"))
    d = (
        selections.select(*CELL).join(cells.select(*CELL, "text"), CELL, "left")
        .join(e, CELL, "left").join(cover, CELL, "left")
    )
    inside = F.col("m").isNotNull() & ~((F.col("m.start_row") == F.col("row")) & (F.col("m.start_col") == F.col("col")))
    own = F.col("page").isNotNull()
    d = d.withColumns({
        "anchor_row": F.when(~own & inside, F.col("m.start_row")), "anchor_col": F.when(~own & inside, F.col("m.start_col")),
    })
    a = e.select("table_id", F.col("row").alias("anchor_row"), F.col("col").alias("anchor_col"),
                 F.col("page").alias("a_page"), F.col("source_text").alias("a_text"))
    d = d.join(a, ["table_id", "anchor_row", "anchor_col"], "left")
    notice = (
        F.when(own, "none").when(F.col("anchor_row").isNotNull(), "merged-subordinate")
        .when(F.col("text").isNotNull() & is_blank("text"), "empty-cell").otherwise("no-source-location")
    )
    return d.select(
        *CELL, notice.alias("notice"), "anchor_row", "anchor_col",
        F.coalesce("page", "a_page").alias("page"), F.coalesce("source_text", "a_text").alias("source_text"),
    )
