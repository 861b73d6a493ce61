"""Order statements as extracted tables: typing, lineage, edits, totals, stitching, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.fixtures import ctes, load
from sheaf.functions.numbers import plain_number
from sheaf.operators import tables as t
from sheaf.session import stage


def _headers(spark, sf):
    return load(spark, sf, "fx_statement_lines").select(F.col("k").alias("table_id")).distinct().withColumn("header_rows", F.lit(1))


def _typed(spark, sf, name="fx_statements"):
    return t.conservative_cast(load(spark, sf, name), _headers(spark, sf))


def _explode(spark, sf):
    rows = load(spark, sf, "fx_statement_rows").select("table_id", "row", F.array("a", "b", "c").alias("cells"))
    cells = t._flag_subordinates(t.explode_cells(rows), load(spark, sf, "fx_merges"))
    return cells.select(*t.CELL, "text", "subordinate")


def _coverage(spark, sf):
    return t.lineage_coverage(load(spark, sf, "fx_statements"), load(spark, sf, "fx_evidence"), load(spark, sf, "fx_merges"))


def _edits(spark, sf):
    return t.diff_tables(_typed(spark, sf), _typed(spark, sf, "fx_statement_edits"))


def _totals(spark, sf):
    return t.reconcile_totals(_typed(spark, sf), load(spark, sf, "fx_merges"), _headers(spark, sf))


def _totals_out(df):
    text = lambda c: F.coalesce(plain_number(c), F.lit("")).alias(c)
    return df.select("table_id", "row", "col", "label", "status", text("actual"), text("expected"), text("difference"),
                     F.coalesce("skip_reason", F.lit("")).alias("skip_reason"))


def _cast_out(spark, sf):
    return _typed(spark, sf).select(*t.CELL, "text", F.coalesce(plain_number("num"), F.lit("")).alias("num"))


def _dates(spark, sf):
    o = load(spark, sf, "orders")
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    text = F.when(F.col("o_custkey") % 5 == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise(day)
    cells = o.select(F.col("o_custkey").alias("table_id"), (F.col("o_orderkey") + 1).alias("row"), F.lit(0).alias("col"), text.alias("text"))
    headers = cells.select("table_id").distinct().withColumn("header_rows", F.lit(1))
    return t.infer_date_columns(cells, headers)


def _fragments(spark, sf):
    f = load(spark, sf, "fx_fragments")
    edges = F.array("left_edge", F.col("left_edge") + 0.3, F.col("left_edge") + 0.6)
    cast = {c: F.col(c).cast("double") for c in ("top", "bottom", "left_edge")}
    return f.withColumns(cast).withColumn("edges", edges).withColumn("ordinal", F.col("page"))


def _stitch(layout):
    def query(spark, sf):
        d = t.stitch_continuations(_fragments(spark, sf), layout=layout)
        return d.select("doc_id", "page", "stitched", "row_offset")
    return query


def _trace(spark, sf):
    cells = load(spark, sf, "fx_statements")
    d = t.trace_cell(cells, load(spark, sf, "fx_evidence"), load(spark, sf, "fx_merges"), cells)
    return d.select(*t.CELL, "notice", F.coalesce("anchor_row", F.lit(-1)).alias("anchor_row"), F.coalesce("page", F.lit(0)).alias("page"),
                    F.coalesce("source_text", F.lit("")).alias("source_text"))


QUERIES = {
    "t1_explode_cells": _explode,
    "t2_lineage_coverage": lambda s, sf: _coverage(s, sf)[0],
    "t2_missing_evidence": lambda s, sf: _coverage(s, sf)[1],
    "t3_diff_tables": lambda s, sf: _edits(s, sf).na.fill(""),
    "t4_find_total_rows": lambda s, sf: t.find_total_rows(_typed(s, sf), load(s, sf, "fx_merges")),
    "t5_reconcile_totals": lambda s, sf: _totals_out(_totals(s, sf).filter("label <> 'grand-total'")),
    "t6_reconcile_grand_totals": lambda s, sf: _totals_out(_totals(s, sf).filter("label = 'grand-total'")),
    "t7_verification_summary": lambda s, sf: t.verification_summary(_coverage(s, sf)[0], _edits(s, sf), _totals(s, sf)),
    "t8_conservative_cast": _cast_out,
    "t8_column_type_profile": lambda s, sf: t.column_type_profile(_typed(s, sf), _headers(s, sf)),
    "t9_infer_date_columns": _dates,
    "t10_infer_header_rows": lambda s, sf: t.infer_header_rows(load(s, sf, "fx_statements")),
    "t10_scanned_header_rows": lambda s, sf: t.infer_header_rows(load(s, sf, "fx_statements"), scanned=True),
    "t11_stitch_ruled": _stitch(False),
    "t11_stitch_layout": _stitch(True),
    "t12_plan_merges": lambda s, sf: t.plan_merges(load(s, sf, "fx_statements"), load(s, sf, "fx_merges")),
    "t13_trace_cell": _trace,
}

_NUMBER = r"""CASE WHEN regexp_matches(coalesce(h.text, ''), '(?i)\b(account|acct|a/c|ecr|employee\s*(id|no|number|code)|reference|ref|code|serial|sr\.?\s*no)\b') THEN NULL
   WHEN regexp_full_match(regexp_replace(trim(c.text), '^-', ''), '(0|[1-9][0-9]*|[1-9][0-9]{0,2}(,[0-9]{3})+)(\.[0-9]+)?')
    AND length(regexp_replace(trim(c.text), '[-,.]', '', 'g')) <= 15 THEN try_cast(replace(trim(c.text), ',', '') AS decimal(38,15)) END"""
_PLAIN = lambda c: f"""CASE WHEN {c} IS NULL THEN '' ELSE regexp_replace(regexp_replace(cast({c} AS varchar), '0+$', ''), '\\.$', '') END"""
_STAGES = {
    "typed": f"""SELECT c.*, {_NUMBER} AS num FROM fx_statements c LEFT JOIN fx_statements h ON h.table_id = c.table_id AND h.row = 0 AND h.col = c.col""",
    "typed2": f"""SELECT c.*, {_NUMBER} AS num FROM fx_statement_edits c LEFT JOIN fx_statement_edits h ON h.table_id = c.table_id AND h.row = 0 AND h.col = c.col""",
    "areas": """SELECT table_id, merge_no, start_row, start_col, row, unnest(generate_series(start_col, end_col)) AS col FROM
        (SELECT *, unnest(generate_series(start_row, end_row)) AS row FROM fx_merges WHERE start_row <= end_row AND start_col <= end_col)""",
    "subs": "SELECT DISTINCT table_id, row, col FROM areas WHERE row <> start_row OR col <> start_col",
    "labelled": r"""SELECT t.*, s.row IS NOT NULL AS sub, CASE WHEN num IS NULL AND s.row IS NULL THEN
        CASE trim(regexp_replace(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'), ':$', ''))
        WHEN 'total' THEN 'total' WHEN 'subtotal' THEN 'subtotal' WHEN 'sub total' THEN 'subtotal'
        WHEN 'grand total' THEN 'grand-total' WHEN 'net total' THEN 'net-total' END END AS label
        FROM typed t LEFT JOIN subs s USING (table_id, row, col)""",
    "cands": """SELECT table_id, row, max(label) AS label, max(CASE WHEN label IS NOT NULL THEN col END) AS label_col, count(num) AS n_targets
        FROM labelled WHERE NOT sub GROUP BY table_id, row HAVING count(label) = 1 AND count(num) > 0""",
    "bounds": "SELECT *, coalesce(lag(row) OVER (PARTITION BY table_id ORDER BY row), 0) AS prev FROM cands",
    "targets": """SELECT b.table_id, b.row, b.label, b.prev, l.col, l.num AS actual FROM bounds b JOIN labelled l
        ON l.table_id = b.table_id AND l.row = b.row AND l.col <> b.label_col AND NOT l.sub AND l.num IS NOT NULL""",
    "plain": """SELECT table_id, row, col, any_value(label) AS label, any_value(actual) AS actual, sum(num) AS expected, count(num) AS n,
        coalesce(bool_or(x IS NOT NULL AND num IS NULL), false) AS dirty FROM (SELECT t.*, l.num, l.row AS x FROM targets t LEFT JOIN labelled l ON l.table_id = t.table_id
          AND l.col = t.col AND l.row > t.prev AND l.row < t.row AND l.row >= 1 AND NOT l.sub AND trim(l.text) <> '') WHERE label <> 'grand-total' GROUP BY table_id, row, col""",
    "checked": """SELECT *, CASE WHEN dirty THEN 'ambiguous-non-numeric-content' WHEN n < 2 THEN 'fewer-than-two-contributors' ELSE '' END AS skip_reason FROM plain""",
    "grand": """SELECT g.table_id, g.row, g.col, g.label, g.actual, count(p.row) AS n, count(DISTINCT p.label) AS kinds, sum(p.actual) AS expected,
        count_if(p.skip_reason <> '') AS na, max(p.row) AS last FROM targets g LEFT JOIN checked p ON p.table_id = g.table_id AND p.col = g.col AND p.row < g.row
        AND p.label IN ('subtotal', 'total') WHERE g.label = 'grand-total' GROUP BY ALL""",
    "grand2": """SELECT *, CASE WHEN kinds <> 1 OR na > 0 OR exists(SELECT 1 FROM labelled l WHERE l.table_id = g.table_id AND l.col = g.col AND l.row > g.last
        AND l.row < g.row AND NOT l.sub AND trim(l.text) <> '') THEN 'ambiguous-grand-total-structure' WHEN n < 2 THEN 'fewer-than-two-contributors' ELSE '' END AS skip_reason FROM grand g""",
    "totals": """SELECT table_id, row, col, label, actual, expected, skip_reason FROM checked
        UNION ALL SELECT table_id, row, col, label, actual, expected, skip_reason FROM grand2""",
    "verdicts": """SELECT *, CASE WHEN skip_reason <> '' THEN 'NOT_APPLICABLE' WHEN actual = expected THEN 'PASS' ELSE 'NEEDS_REVIEW' END AS status FROM totals""",
    "cover": """SELECT c.table_id, c.row, c.col, c.text, s.row IS NOT NULL AS sub, e.row IS NOT NULL AS backed FROM fx_statements c
        LEFT JOIN subs s USING (table_id, row, col) LEFT JOIN fx_evidence e USING (table_id, row, col) WHERE trim(c.text) <> ''""",
    "edits": f"""SELECT table_id, row, col, CASE WHEN a.num IS NULL THEN coalesce(a.text, '') ELSE {_PLAIN('a.num')} END AS before,
        CASE WHEN b.num IS NULL THEN coalesce(b.text, '') ELSE {_PLAIN('b.num')} END AS after,
        CASE WHEN a.text IS NULL THEN 'added' WHEN b.text IS NULL THEN 'removed' ELSE 'changed' END AS kind
        FROM typed a FULL JOIN typed2 b USING (table_id, row, col)
        WHERE a.text IS NULL OR b.text IS NULL OR (a.num IS NULL) <> (b.num IS NULL) OR coalesce(a.num <> b.num, a.text <> b.text)""",
}
_FX = ctes("fx_merges", "fx_statements", "fx_evidence", "fx_statement_edits")
_ALL = ", ".join(f"{n} AS ({s})" for n, s in _STAGES.items())
_WITH = f"WITH {_FX}, {_ALL}"
_TOTAL = f"""SELECT table_id, row, col, label, status, {_PLAIN('actual')} AS actual, CASE WHEN skip_reason <> '' THEN '' ELSE {_PLAIN('expected')} END AS expected,
    CASE WHEN skip_reason <> '' THEN '' ELSE {_PLAIN('(actual - expected)')} END AS difference, skip_reason FROM verdicts"""
_LINKED = """WITH {fx}, seq AS (SELECT *, lag(page) OVER w AS pp, lag(n_cols) OVER w AS pc, lag(last_key) OVER w AS pk, lag(bottom) OVER w AS pb,
    lag(left_edge) OVER w AS pe FROM fx_fragments WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
    near AS (SELECT *, coalesce(pp + 1 = page AND pc = n_cols AND pk + 1 = first_key AND top <= {high}, false) AS near FROM seq)"""
_FXF = ctes("fx_fragments")
_NUMBERED = """SELECT doc_id, page, cast(sum(s) OVER (PARTITION BY doc_id ORDER BY page) AS bigint) AS stitched, n_rows FROM flagged"""
_OFFSETS = """SELECT doc_id, page, stitched, cast(coalesce(sum(n_rows) OVER (PARTITION BY doc_id, stitched ORDER BY page
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS row_offset FROM numbered"""

ORACLES = {
    "t1_explode_cells": f"{_WITH} SELECT table_id, row, col, text, s.row IS NOT NULL AS subordinate FROM fx_statements LEFT JOIN subs s USING (table_id, row, col)",
    "t2_lineage_coverage": f"""{_WITH} SELECT table_id, count(*) AS non_empty, count_if(NOT sub AND backed) AS backed, count_if(sub) AS excluded,
        count_if(NOT sub AND NOT backed) AS missing, CASE WHEN count_if(NOT sub AND NOT backed) > 0 THEN 'NEEDS_REVIEW' ELSE 'PASS' END AS status FROM cover GROUP BY table_id""",
    "t2_missing_evidence": f"{_WITH} SELECT table_id, row, col, text FROM cover WHERE NOT sub AND NOT backed",
    "t3_diff_tables": f"{_WITH} SELECT * FROM edits",
    "t4_find_total_rows": f"{_WITH} SELECT * FROM cands",
    "t5_reconcile_totals": f"{_WITH} {_TOTAL} WHERE label <> 'grand-total'",
    "t6_reconcile_grand_totals": f"{_WITH} {_TOTAL} WHERE label = 'grand-total'",
    "t7_verification_summary": f"""{_WITH}, c AS (SELECT table_id, count_if(NOT sub AND backed) AS source_linked, count_if(NOT sub AND NOT backed) AS missing_source FROM cover GROUP BY table_id),
        e AS (SELECT table_id, count(*) AS edited_cells FROM edits GROUP BY table_id),
        v AS (SELECT table_id, count_if(status <> 'NOT_APPLICABLE') AS applicable_totals, count_if(status = 'PASS') AS passed_totals, count_if(status = 'NEEDS_REVIEW') AS totals_to_review FROM verdicts GROUP BY table_id)
        SELECT table_id, coalesce(source_linked, 0) AS source_linked, coalesce(missing_source, 0) AS missing_source, coalesce(edited_cells, 0) AS edited_cells,
          coalesce(applicable_totals, 0) AS applicable_totals, coalesce(passed_totals, 0) AS passed_totals, coalesce(totals_to_review, 0) AS totals_to_review
        FROM c FULL JOIN e USING (table_id) FULL JOIN v USING (table_id)""",
    "t8_conservative_cast": f"{_WITH} SELECT table_id, row, col, text, {_PLAIN('num')} AS num FROM typed",
    "t8_column_type_profile": f"{_WITH} SELECT table_id, col, count(*) AS cells, count(num) AS numeric, count(num) / count(*) AS share FROM typed WHERE row >= 1 AND trim(text) <> '' GROUP BY ALL",
    "t9_infer_date_columns": """SELECT o_custkey AS table_id, 0 AS col, count_if(o_custkey % 5 <> 0 AND o_orderkey % 3 <> 0) AS dates, count(*) AS filled
        FROM orders GROUP BY o_custkey HAVING dates >= 2 AND dates >= filled * 0.3""",
    "t10_infer_header_rows": f"""WITH {ctes('fx_statements')}, n AS (SELECT table_id, row, count_if(regexp_matches(trim(text), '^-?[0-9][0-9,.]*$')) AS k FROM fx_statements GROUP BY ALL)
        SELECT table_id, cast(coalesce(least(min(CASE WHEN row > 0 AND k >= 2 THEN row END), 4), 1) AS int) AS header_rows FROM n GROUP BY table_id""",
    "t10_scanned_header_rows": f"""WITH {ctes('fx_statements')} SELECT table_id, CASE WHEN count_if(row = 0 AND regexp_matches(text, '[0-9]')) <= 1
        AND count_if(row = 0 AND regexp_matches(text, '[A-Za-z][A-Za-z]')) >= 2 THEN 1 ELSE 0 END AS header_rows FROM fx_statements GROUP BY table_id""",
    "t11_stitch_layout": f"""{_LINKED.format(fx=_FXF, high=0.18)}, flagged AS (SELECT *, CASE WHEN near AND pb >= 0.78 AND abs(pe - left_edge) < 0.008 THEN 0 ELSE 1 END AS s FROM near),
        numbered AS ({_NUMBERED}) {_OFFSETS}""",
    # The chain rule is sequential: walk each document fragment by fragment.
    "t11_stitch_ruled": f"""WITH RECURSIVE {_LINKED.format(fx=_FXF, high=0.1)[5:]}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i FROM near),
        walk AS (SELECT doc_id, page, n_rows, i, 1 AS s, left_edge AS fe, bottom AS maxb FROM r WHERE i = 1
          UNION ALL SELECT r.doc_id, r.page, r.n_rows, r.i, CASE WHEN r.near AND w.maxb >= 0.9 AND abs(w.fe - r.left_edge) <= 0.02 THEN 0 ELSE 1 END,
            CASE WHEN r.near AND w.maxb >= 0.9 AND abs(w.fe - r.left_edge) <= 0.02 THEN w.fe ELSE r.left_edge END,
            CASE WHEN r.near AND w.maxb >= 0.9 AND abs(w.fe - r.left_edge) <= 0.02 THEN greatest(w.maxb, r.bottom) ELSE r.bottom END
          FROM walk w JOIN r ON r.doc_id = w.doc_id AND r.i = w.i + 1),
        flagged AS (SELECT * FROM walk), numbered AS ({_NUMBERED}) {_OFFSETS}""",
    "t12_plan_merges": f"""WITH {ctes('fx_merges', 'fx_statements')}, ext AS (SELECT table_id, max(row) AS mr FROM fx_statements GROUP BY ALL)
        SELECT table_id, merge_no, CASE table_id % 4 WHEN 1 THEN 'applied' WHEN 2 THEN (CASE merge_no WHEN 1 THEN 'applied' ELSE 'skipped' END) ELSE 'skipped' END AS outcome
        FROM fx_merges WHERE NOT (table_id % 4 = 2 AND merge_no IN (2, 3))""",
    "t13_trace_cell": f"""{_WITH}, cv AS (SELECT table_id, row, col, min_by(start_row, merge_no) AS sr, min_by(start_col, merge_no) AS sc FROM areas GROUP BY ALL),
        j AS (SELECT c.*, e.page AS ep, e.source_text AS es, cv.sr, cv.sc, e.page IS NULL AND cv.sr IS NOT NULL AND NOT (cv.sr = c.row AND cv.sc = c.col) AS inner_cell
          FROM fx_statements c LEFT JOIN fx_evidence e USING (table_id, row, col) LEFT JOIN cv USING (table_id, row, col))
        SELECT j.table_id, j.row, j.col, CASE WHEN ep IS NOT NULL THEN 'none' WHEN inner_cell THEN 'merged-subordinate' WHEN trim(text) = '' THEN 'empty-cell' ELSE 'no-source-location' END AS notice,
          CASE WHEN inner_cell THEN sr ELSE -1 END AS anchor_row, coalesce(ep, CASE WHEN inner_cell THEN a.page END, 0) AS page, coalesce(es, CASE WHEN inner_cell THEN a.source_text END, '') AS source_text
        FROM j LEFT JOIN fx_evidence a ON a.table_id = j.table_id AND a.row = j.sr AND a.col = j.sc""",
}
