"""Orders against their generated documents."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheaf.fixtures import ctes, load
from sheaf.functions.numbers import NumberRule, decimal_key
from sheaf.functions.text import normalize_text
from sheaf.operators import reconcile as r
from sheaf.session import stage

SETUP = r.Setup(
    key_column="order_id",
    key_anchor="Order:",
    fields=(
        r.FieldRule("customer", "Customer:"),
        r.FieldRule("total", "Total:", "number", NumberRule(".", ",", "$", 2)),
    ),
)


class Reconciliation:
    """The stages of one run, built on demand. What feeds several stages (spans, hits, assignments, fields, verdicts) is staged."""

    def __init__(self, records: DataFrame, items: DataFrame, pages: DataFrame, setup: r.Setup):
        self.records, self.items, self.page_list, self.setup = records, items, pages, setup

    @cached_property
    def spans(self) -> DataFrame:
        return stage(r.build_spans(self.items))

    @cached_property
    def hits(self) -> DataFrame:
        return stage(r.find_key_hits(self.spans, self.records))

    @cached_property
    def anchors(self) -> DataFrame:
        return r.anchored_values(self.spans, self.setup)

    @cached_property
    def assigned(self) -> DataFrame:
        return stage(r.assign_pages(self.page_list, self.hits, self.anchors, self.setup))

    @cached_property
    def fields(self) -> DataFrame:
        return stage(r.compare_fields(self.assigned, self.records, self.anchors, self.setup))

    @cached_property
    def pages(self) -> DataFrame:
        return stage(r.page_status(self.page_list, self.assigned, self.fields))

    @cached_property
    def sources(self) -> DataFrame:
        return r.source_status(self.records, self.pages, self.hits)

    @cached_property
    def summary(self) -> DataFrame:
        return r.reconciliation_summary(self.sources, self.pages)

    @cached_property
    def outcome(self) -> DataFrame:
        return r.source_outcome(self.sources, self.pages, self.fields, self.hits)


def orders_run(spark: SparkSession, sf: str) -> Reconciliation:
    records = r.records_from(load(spark, sf, "fx_records"), "order_id")
    pages = load(spark, sf, "fx_order_pages").select("doc_id", "page", "visibility_review")
    return Reconciliation(records, load(spark, sf, "fx_order_items"), pages, SETUP)


def _spans(spark, sf):
    s = orders_run(spark, sf).spans
    return s.select(
        "doc_id", "page", "span_no", "text", F.array_join(F.col("item_idx").cast("array<string>"), ",").alias("items"),
        F.element_at(F.col("parts"), -1)["end"].cast("bigint").alias("end_offset"),
    )


def _fields(spark, sf):
    return orders_run(spark, sf).fields.select(
        "doc_id", "page", "key", "rule_no", "expected", "observed", "n_observed", "status"
    )


def _decimal(spark, sf):
    o = load(spark, sf, "fx_records")
    # Three spellings per amount: plain, grouped with currency, and a broken grouping.
    dollars = F.regexp_extract("total", r"^(\d+)", 1)
    grouped = F.regexp_replace("total", r"(\d)(?=(?:\d{3})+\.)", "$1,")
    texts = F.array(F.col("total"), F.concat(F.lit("$"), grouped), F.concat(F.lit(" -"), grouped),
                    F.concat(F.lit("0"), F.col("total")), F.concat(dollars, F.lit(",00.5")))
    d = o.select("record_no", F.posexplode(texts).alias("variant", "text"))
    return d.select("record_no", "variant", "text",
                    F.coalesce(decimal_key(normalize_text("text"), SETUP.fields[1].number), F.lit("none")).alias("value"))


def _pages_out(spark, sf):
    return orders_run(spark, sf).pages.select(
        "doc_id", "page", F.coalesce("key", F.lit("")).alias("key"), "n_candidates", "status"
    )


def _assigned(spark, sf):
    return orders_run(spark, sf).assigned.select(
        "doc_id", "page", F.coalesce("key", F.lit("")).alias("key"), "n_candidates", "ambiguous"
    )


def _bad_values(spark, sf):
    """Customer names are not numbers: the data check must count every such record."""
    records = r.records_from(load(spark, sf, "fx_records"), "order_id")
    setup = r.Setup("order_id", "Order:", (
        r.FieldRule("total", "Total:", "number", NumberRule(".", ",", "$", 0)),
        r.FieldRule("customer", "Customer:", "number", NumberRule(".", ",", "", 2)),
    ))
    return r.unparsable_values(records, setup)


def _operators(spark, sf):
    pages = load(spark, sf, "fx_order_pages")
    ops = F.when(F.col("page") % 7 == 0, F.array(F.lit("save"), F.lit("setFont"))).otherwise(
        F.array(F.lit("save"), F.lit("showText"), F.lit("restore")))
    return pages.select("doc_id", "page", F.explode(ops).alias("op"))


def _blank(spark, sf):
    items = load(spark, sf, "fx_order_items")
    # Pages of every third order lose their text.
    blanked = items.withColumn("text", F.when(F.col("page") % 3 == 0, F.lit("  ")).otherwise(F.col("text")))
    return r.blank_pages(blanked, _operators(spark, sf))


#: Texts about all orders, and keys of several words, with signs or of signs only.
_TEXTS = """SELECT o_orderkey AS doc_id, 1 AS page, o_custkey AS span_no, 'Ref. Order no. ' || o_orderkey || ', customer #' || o_custkey
    || '; see Order no. ' || (o_orderkey + 1) || CASE WHEN o_orderkey % 5 = 0 THEN ' §§ and §§' WHEN o_orderkey % 5 = 1 THEN ', Order no. ' || o_orderkey
    ELSE ' as Order no.' || o_orderkey END AS text FROM orders"""
_KEYS = """SELECT 'Order no. ' || o_orderkey AS norm_key FROM orders WHERE o_orderkey % 3 > 0 UNION ALL
    SELECT '#' || c_custkey AS norm_key FROM customer UNION ALL SELECT '§§' AS norm_key UNION ALL SELECT '§§§' AS norm_key"""


def _marked_hits(s, sf):
    for name in ("orders", "customer"):
        s.read.parquet(f"{sf}/{name}.parquet").createOrReplaceTempView(f"marked_{name}")
    named = lambda sql: sql.replace("FROM orders", "FROM marked_orders").replace("FROM customer", "FROM marked_customer")
    return r.find_key_hits(s.sql(named(_TEXTS)), s.sql(named(_KEYS)))


QUERIES = {
    "r1_build_spans": _spans,
    "r2_marked_key_hits": _marked_hits,
    "r2_find_key_hits": lambda s, sf: orders_run(s, sf).hits,
    "r3_anchored_values": lambda s, sf: orders_run(s, sf).anchors,
    "r4_assign_pages": _assigned,
    "r5_compare_fields": _fields,
    "r6_decimal_key": _decimal,
    "r7_page_status": _pages_out,
    "r8_source_status": lambda s, sf: orders_run(s, sf).sources,
    "r9_reconciliation_summary": lambda s, sf: orders_run(s, sf).summary,
    "r10_source_outcome": lambda s, sf: orders_run(s, sf).outcome,
    "r11_validate_setup": _bad_values,
    "r12_blank_pages": _blank,
}

_FX = ctes("fx_order_items", "fx_records")
_STAGES = {
    "lagged": """SELECT *, lag(y) OVER w AS py, lag(x) OVER w AS px, lag(advance) OVER w AS pa, lag(size) OVER w AS ps
        FROM fx_order_items WHERE length(text) > 0 WINDOW w AS (PARTITION BY doc_id, page ORDER BY y, x, idx)""",
    "flagged": """SELECT *, CASE WHEN py IS NOT NULL AND abs(y - py) <= least(size, ps) * 0.12 AND abs(size - ps) <= 0.5
          AND x - px - pa >= -0.25 AND x - px - pa <= size * 1.5 THEN 0 ELSE 1 END AS s,
          CASE WHEN x - px - pa > size * 0.2 THEN ' ' ELSE '' END AS sep FROM lagged""",
    "islands": "SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY y, x, idx) AS span_no FROM flagged",
    "spans": """SELECT doc_id, page, cast(span_no AS bigint) AS span_no,
          string_agg(CASE WHEN s = 1 THEN '' ELSE sep END || text, '' ORDER BY y, x, idx) AS text,
          string_agg(cast(idx AS varchar), ',' ORDER BY y, x, idx) AS items
          FROM islands GROUP BY doc_id, page, span_no""",
    "runs": r"""SELECT doc_id, page, span_no, unnest(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_./-]+')) AS key FROM spans""",
    "hits": """SELECT doc_id, page, span_no, key, count(*) AS occurrences FROM runs
          JOIN fx_records ON key = order_id GROUP BY ALL""",
    "anchors": """SELECT doc_id, page, span_no, rule_no, trim(substr(text, length(label) + 1)) AS value
          FROM spans JOIN (VALUES (-1, 'Order:'), (0, 'Customer:'), (1, 'Total:')) v(rule_no, label)
          ON starts_with(text, label)""",
    "per_page": """SELECT doc_id, page, count(DISTINCT key) AS n, max(key) AS sole FROM hits GROUP BY ALL""",
    "assigned": """SELECT p.doc_id, p.page, coalesce(n, 0) AS n_candidates,
          CASE WHEN n = 1 AND (SELECT count(*) FROM anchors a WHERE a.doc_id = p.doc_id AND a.page = p.page
               AND a.rule_no = -1 AND a.value = x.sole) = 1 THEN sole END AS key, p.visibility_review
          FROM fx_order_pages p LEFT JOIN per_page x ON x.doc_id = p.doc_id AND x.page = p.page""",
    "observed": """SELECT doc_id, page, rule_no, count(*) AS n_observed, min_by(value, span_no) AS observed
          FROM anchors WHERE rule_no >= 0 GROUP BY ALL""",
    "fields": """SELECT *, CASE WHEN n_observed > 1 THEN 'AMBIGUOUS FIELD' WHEN n_observed = 0 OR observed = '' THEN 'FIELD MISSING'
          WHEN rule_no = 0 AND expected = observed THEN 'PASS'
          WHEN rule_no = 1 AND cast(expected AS decimal(18,2)) = cast(replace(replace(observed, '$', ''), ',', '') AS decimal(18,2)) THEN 'PASS'
          ELSE 'FIELD MISMATCH' END AS status
          FROM (SELECT a.doc_id, a.page, a.key, v.rule_no, CASE v.rule_no WHEN 0 THEN customer ELSE total END AS expected,
                  coalesce(o.observed, '') AS observed, coalesce(o.n_observed, 0) AS n_observed
                FROM assigned a JOIN fx_records r ON a.key = r.order_id, (VALUES (0), (1)) v(rule_no)
                LEFT JOIN observed o ON o.doc_id = a.doc_id AND o.page = a.page AND o.rule_no = v.rule_no)""",
    "page_findings": """SELECT a.doc_id, a.page, a.key, a.n_candidates, CASE WHEN visibility_review THEN 'UNSUPPORTED VISIBILITY / REVIEW'
          WHEN a.key IS NULL AND n_candidates > 0 THEN 'AMBIGUOUS KEY' WHEN a.key IS NULL THEN 'UNRESOLVED OUTPUT PAGE'
          WHEN bad > 0 THEN 'FIELD REVIEW' ELSE 'PASS' END AS status
          FROM assigned a LEFT JOIN (SELECT doc_id, page, count_if(status <> 'PASS') AS bad FROM fields GROUP BY ALL) f
          ON f.doc_id = a.doc_id AND f.page = a.page""",
    "uncertain": """SELECT DISTINCT h.key FROM hits h JOIN page_findings p ON p.doc_id = h.doc_id AND p.page = h.page WHERE p.key IS NULL""",
    "sources": """SELECT record_no, order_id AS key, coalesce(n, 0) AS n_pages, CASE WHEN n > 1 THEN 'DUPLICATE OUTPUT RECORD'
          WHEN u.key IS NOT NULL THEN 'REVIEW' WHEN n IS NULL THEN 'MISSING OUTPUT RECORD'
          WHEN passed THEN 'PASS' ELSE 'REVIEW' END AS status
          FROM fx_records LEFT JOIN (SELECT key, count(*) AS n, bool_and(status = 'PASS') AS passed FROM page_findings
            WHERE key IS NOT NULL GROUP BY key) p ON p.key = order_id LEFT JOIN uncertain u ON u.key = order_id""",
}


def _oracle(last: str, upto: str | None = None) -> str:
    parts = []
    for name, text in _STAGES.items():
        parts.append(f"{name} AS ({text})")
        if name == upto:
            break
    return f"WITH {_FX}, {', '.join(parts)} {last}"


ORACLES = {
    "r1_build_spans": _oracle("SELECT doc_id, page, span_no, text, items, cast(length(text) AS bigint) AS end_offset FROM spans", "spans"),
    "r2_find_key_hits": _oracle("SELECT doc_id, page, span_no, key, occurrences FROM hits", "hits"),
    "r2_marked_key_hits": rf"""WITH texts AS ({_TEXTS}), keys AS (SELECT DISTINCT norm_key AS key FROM ({_KEYS})),
        runs AS (SELECT doc_id, page, span_no, unnest(regexp_extract_all(text, 'Order no\. [\p{{L}}\p{{N}}\p{{M}}_./-]+|#[\p{{L}}\p{{N}}\p{{M}}_./-]+|§+')) AS key FROM texts)
        SELECT doc_id, page, span_no, key, count(*) AS occurrences FROM runs JOIN keys USING (key) GROUP BY ALL""",
    "r3_anchored_values": _oracle("SELECT doc_id, page, span_no, rule_no, value FROM anchors", "anchors"),
    "r4_assign_pages": _oracle(
        "SELECT doc_id, page, coalesce(key, '') AS key, n_candidates, key IS NULL AND n_candidates > 0 AS ambiguous FROM assigned", "assigned"),
    "r5_compare_fields": _oracle("SELECT doc_id, page, key, rule_no, expected, observed, n_observed, status FROM fields", "fields"),
    "r6_decimal_key": f"""WITH {ctes('fx_records')},
        g AS (SELECT record_no, total, cast(floor(cast(total AS decimal(18,2))) AS bigint) AS d, cast(cast(total AS decimal(18,2)) * 100 AS bigint) AS cents FROM fx_records),
        t AS (SELECT *, format('{{:,}}', d) || right(total, 3) AS grp FROM g)
        SELECT record_no, variant, text, value FROM (
          SELECT record_no, 0 AS variant, total AS text, cast(cents AS varchar) AS value FROM t
          UNION ALL SELECT record_no, 1, '$' || grp, cast(cents AS varchar) FROM t
          UNION ALL SELECT record_no, 2, ' -' || grp, cast(-cents AS varchar) FROM t
          UNION ALL SELECT record_no, 3, '0' || total, CASE WHEN d = 0 THEN 'none' ELSE 'none' END FROM t
          UNION ALL SELECT record_no, 4, cast(d AS varchar) || ',00.5', 'none' FROM t)""",
    "r7_page_status": _oracle("SELECT doc_id, page, coalesce(key, '') AS key, n_candidates, status FROM page_findings", "page_findings"),
    "r8_source_status": _oracle("SELECT record_no, key, n_pages, status FROM sources"),
    "r9_reconciliation_summary": _oracle("""SELECT s.*, p.* FROM (SELECT count(*) AS source_records, count_if(status = 'PASS') AS passed_records,
        count_if(status IN ('REVIEW', 'DUPLICATE OUTPUT RECORD')) AS failed_or_review_records,
        count_if(status = 'MISSING OUTPUT RECORD') AS missing_records,
        cast(sum(greatest(0, n_pages - 1)) AS bigint) AS duplicate_instances FROM sources) s,
        (SELECT count_if(key IS NULL AND n_candidates = 0) AS unresolved_pages, cast(0 AS bigint) AS blank_pages,
        count_if(key IS NULL AND n_candidates > 0) AS ambiguous_pages, count_if(key IS NOT NULL) AS assigned_pages,
        count(*) AS output_pages, count_if(status LIKE 'UNSUPPORTED%') AS visibility_review_pages FROM page_findings) p"""),
    "r10_source_outcome": _oracle("""SELECT s.record_no, s.key, CASE WHEN s.status <> 'REVIEW' THEN s.status
        WHEN exists(SELECT 1 FROM page_findings p JOIN hits h ON h.doc_id = p.doc_id AND h.page = p.page
             WHERE p.status LIKE 'UNSUPPORTED%' AND h.key = s.key) THEN 'VISIBILITY REVIEW'
        WHEN exists(SELECT 1 FROM page_findings p JOIN hits h ON h.doc_id = p.doc_id AND h.page = p.page
             WHERE p.status = 'AMBIGUOUS KEY' AND h.key = s.key) THEN 'AMBIGUOUS KEY'
        ELSE coalesce((SELECT min_by(f.status, f.page * 10 + f.rule_no) FROM fields f WHERE f.key = s.key AND f.status <> 'PASS'), 'REVIEW') END AS outcome
        FROM sources s"""),
    "r11_validate_setup": """SELECT 0 AS rule_no, 'total' AS "column", count(*) AS bad_values, min(o_orderkey) AS first_record FROM orders HAVING count(*) > 0""",
    "r12_blank_pages": f"""WITH {_FX} SELECT doc_id, page, page % 3 = 0 AND page % 7 = 0 AS blank FROM fx_order_pages""",
}
