"""Reconciliation of source records against text found in generated output.

Tables: ``items(doc_id, page, idx, text, x, y, advance, size[, box])``,
``records(norm_key, cells map, record_no)``, ``pages(doc_id, page, visibility_review, blank)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from sheaf.functions import ordered
from sheaf.functions.numbers import NumberRule, decimal_key, identifier_heading
from sheaf.functions.text import TOKEN_CLASS, WS, is_blank, js_trim, normalize_text

PAGE = ["doc_id", "page"]
# Vertical band used to split one page over several tasks; spans only join near baselines.
BAND_POINTS = 64.0

# Drawing instructions that set state and paint nothing.
NON_PAINTING = (
    "dependency", "save", "restore", "transform",
    "setLineWidth", "setLineCap", "setLineJoin", "setMiterLimit", "setDash",
    "setRenderingIntent", "setFlatness",
    "beginText", "endText", "setCharSpacing", "setWordSpacing", "setHScale",
    "setLeading", "setFont", "setTextRenderingMode", "setTextRise",
    "moveText", "setLeadingMoveText", "setTextMatrix", "nextLine",
    "setStrokeColorSpace", "setFillColorSpace", "setStrokeColor", "setFillColor",
    "setStrokeGray", "setFillGray", "setStrokeRGBColor", "setFillRGBColor",
    "setStrokeCMYKColor", "setFillCMYKColor", "setStrokeTransparent", "setFillTransparent",
)


@dataclass(frozen=True)
class FieldRule:
    """One compared source column and the label that introduces it in the output."""

    column: str
    anchor: str
    mode: str = "exact"
    number: NumberRule | None = None


@dataclass(frozen=True)
class Setup:
    key_column: str
    key_anchor: str | None
    fields: Sequence[FieldRule] = field(default_factory=tuple)


def setup_problems(setup: Setup, headers: Sequence[str]) -> list[str]:
    """Problems of the configuration itself (config-sized, checked on the driver)."""
    import re
    import unicodedata

    from sheaf.functions.numbers import IDENTIFIER_HEADING

    norm = lambda s: unicodedata.normalize("NFC", s or "").strip()
    out = []
    if not norm(setup.key_anchor).endswith(":"):
        out.append("key label must end in a colon")
    if not 1 <= len(setup.fields) <= 10:
        out.append("between 1 and 10 fields")
    anchors: set[str] = set()
    columns: set[str] = set()
    for f in setup.fields:
        anchor = norm(f.anchor)
        if f.column not in headers or f.column == setup.key_column:
            out.append(f"{f.column}: not a non-key source column")
        if not anchor.endswith(":"):
            out.append(f"{f.column}: label must end in a colon")
        if anchor in anchors or f.column in columns or anchor == norm(setup.key_anchor):
            out.append(f"{f.column}: label or column used twice")
        anchors.add(anchor)
        columns.add(f.column)
        if f.mode not in ("exact", "number"):
            out.append(f"{f.column}: unknown mode")
        elif f.mode == "number":
            if re.search(IDENTIFIER_HEADING[4:], f.column, re.I):
                out.append(f"{f.column}: identifier columns compare as exact text")
            if f.number is None or f.number.problem() or f.number.max_fraction_digits not in (0, 2, 3, 4):
                out.append(f"{f.column}: unsupported number format")
    return out


def unparsable_values(records: DataFrame, setup: Setup) -> DataFrame:
    """Source values that do not parse under their numeric rule: (rule_no, column, bad_values, first_record)."""
    numeric = [(i, f) for i, f in enumerate(setup.fields) if f.mode == "number"]
    if not numeric:
        return records.select(
            F.lit(0).alias("rule_no"), F.lit("").alias("column"),
            F.lit(0).cast("bigint").alias("bad_values"), F.col("record_no").alias("first_record"),
        ).filter(F.lit(False))
    rows = records.select(
        "record_no",
        F.inline(F.array(*[
            F.struct(F.lit(i).alias("rule_no"), F.lit(f.column).alias("column"),
                     decimal_key(normalize_text(F.col("cells")[f.column]), f.number).isNull().alias("bad"))
            for i, f in numeric
        ])),
    )
    return (
        rows.filter("bad").groupBy("rule_no", "column")
        .agg(F.count("*").alias("bad_values"), F.min("record_no").alias("first_record"))
    )


def build_spans(items: DataFrame) -> DataFrame:
    """Join items of one baseline into spans: (doc_id, page, span_no, text, item_idx, parts[, boxes])."""
    box = [c for c in ("box",) if c in items.columns]
    used = items.filter(F.length("text") > 0).select(*PAGE, "idx", "text", "x", "y", "advance", "size", *box)

    def gap(cur, prev) -> Column:
        return cur("x") - prev("x") - prev("advance")

    def starts(cur, prev) -> Column:
        joined = (
            (F.abs(cur("y") - prev("y")) <= F.least(cur("size"), prev("size")) * 0.12)
            & (F.abs(cur("size") - prev("size")) <= 0.5)
            & (gap(cur, prev) >= -0.25)
            & (gap(cur, prev) <= cur("size") * 1.5)
        )
        return ~joined

    d = ordered.with_previous(
        used, PAGE, ["y", "x", "idx"], ["x", "y", "advance", "size", "text"],
        block=ordered.block_of("y", BAND_POINTS), starts=starts, island="span_no",
    )
    prev = F.col("prev")
    spaced = (
        prev.isNotNull()
        & (F.col("x") - prev["x"] - prev["advance"] > F.col("size") * 0.2)
        & ~prev["text"].rlike(WS + "$")
        & ~F.col("text").rlike("^" + WS)
    )
    d = d.withColumn("sep", F.when(spaced, F.lit(" ")).otherwise(F.lit("")))
    members = F.array_sort(F.collect_list(F.struct("y", "x", "idx", "text", "sep", *box)))
    g = d.groupBy(*PAGE, "span_no").agg(members.alias("m"))
    first_blank = lambda x, i: F.when(i == 0, F.lit("")).otherwise(x["sep"])
    text = F.array_join(F.transform("m", lambda x, i: F.concat(first_blank(x, i), x["text"])), "")
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<index:int,start:int,end:int>>").alias("p"))

    def step(acc, x):
        at = acc["n"] + F.when(F.size(acc["p"]) == 0, 0).otherwise(F.length(x["sep"]))
        end = at + F.length(x["text"])
        part = F.struct(x["idx"].cast("int").alias("index"), at.alias("start"), end.alias("end"))
        return F.struct(end.alias("n"), F.concat(acc["p"], F.array(part)).alias("p"))

    return g.select(
        *PAGE, "span_no", text.alias("text"), F.transform("m", lambda x: x["idx"]).alias("item_idx"),
        F.aggregate("m", zero, step, lambda a: a["p"]).alias("parts"),
        *[F.transform("m", lambda x: x["box"]).alias("boxes") for _ in box],
    )


def normalized_spans(spans: DataFrame) -> DataFrame:
    return spans.withColumn("norm", normalize_text("text"))


def _occurrences(text: Column, key: Column) -> Column:
    """Left-to-right, non-overlapping count of ``key`` with token boundaries on both sides."""
    literal = F.concat(F.lit("\\Q"), F.replace(key, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pieces = F.split(text, literal, -1)
    last, first = F.right(key, F.lit(1)), F.left(key, F.lit(1))
    token = lambda c: c.rlike(f"[{TOKEN_CLASS}]")

    def valid(i):
        left = F.element_at(pieces, (i + 1).cast("int"))
        right = F.element_at(pieces, (i + 2).cast("int"))
        before = F.when(left != "", F.right(left, F.lit(1))).when(i > 0, last).otherwise("")
        after = F.when(right != "", F.left(right, F.lit(1))).when(i < F.size(pieces) - 2, first).otherwise("")
        return ~token(before) & ~token(after)

    positions = F.when(F.size(pieces) > 1, F.sequence(F.lit(0), F.size(pieces) - 2)).otherwise(
        F.array().cast("array<int>")
    )
    return F.size(F.filter(positions, valid)).cast("bigint")


#: Neighbouring runs (or characters) that together look up a key.
GRAM = 3


def _grams(parts: Column, n: int) -> Column:
    """Hashes of all ``n`` neighbours in an array; empty where there are fewer."""
    many = F.size(parts) - n + 1
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), many))
    return F.when(many > 0, F.transform(at, lambda i: F.xxhash64(F.lit(n), F.slice(parts, i, n)))).otherwise(F.array().cast("array<bigint>"))


def _shuffled(side: DataFrame) -> DataFrame:
    """Keys, grams and spans grow with the records: their estimate is that of packed files, so none of them is sent whole
    through the driver."""
    return side.hint("merge")


def _looked_up(text: DataFrame, keys: DataFrame, parts: Column) -> DataFrame:
    """(doc_id, page, span_no, key): spans that may hold keys, by the grams of ``parts``.

    A key is looked up by one of its grams, of as many neighbours as it has parts or GRAM: the one that fewest keys
    have. So every place in a text leads to the few keys of that gram, however many keys start alike."""
    sized = keys.select("key", parts.alias("parts"))
    each = [sized.where(F.size("parts") == n if n < GRAM else F.size("parts") >= n).select("key", F.explode(_grams(F.col("parts"), n)).alias("gram"))
            for n in range(1, GRAM + 1)]
    wanted = [r["n"] for r in sized.select(F.least(F.size("parts"), F.lit(GRAM)).alias("n")).distinct().collect()]  # GRAM rows at most
    grams = each[0].unionByName(each[1]).unionByName(each[2])
    often = grams.groupBy("gram").agg(F.count_distinct("key").alias("of"))
    probes = grams.join(_shuffled(often), "gram").groupBy("key").agg(F.min(F.struct("of", "gram"))["gram"].alias("gram"))
    held = F.array_distinct(F.concat(F.array().cast("array<bigint>"), *[_grams(F.col("parts"), n) for n in wanted]))
    places = text.select(*PAGE, "span_no", parts.alias("parts")).select(*PAGE, "span_no", F.explode(held).alias("gram"))
    return places.join(_shuffled(probes), "gram").select(*PAGE, "span_no", "key")


def find_key_hits(spans: DataFrame, records: DataFrame) -> DataFrame:
    """(doc_id, page, span_no, key, occurrences) for every record key found in a span.

    A key made of token characters occurs exactly where a maximal token run equals it, so the
    search is an equi-join on runs. In any other key the token runs are maximal runs of the text
    too, one after the other, and a key without token characters lies inside one run of others:
    such keys are looked up by a few neighbouring runs or characters, and only the spans this
    leads to are read again to count exactly.
    """
    keys = records.select(F.col("norm_key").alias("key")).distinct()
    run, rest = f"[{TOKEN_CLASS}]+", f"[^{TOKEN_CLASS}]+"
    runs = lambda c: F.regexp_extract_all(c, F.lit(run), 0)
    keys = keys.select("key", F.col("key").rlike(f"^{run}$").alias("simple"), F.col("key").rlike(run).alias("with_runs"))
    text = normalized_spans(spans).select(*PAGE, "span_no", "norm")
    plain = (
        text.select(*PAGE, "span_no", F.explode(runs("norm")).alias("key"))
        .join(_shuffled(keys.filter("simple").select("key")), "key")
        .groupBy(*PAGE, "span_no", "key").agg(F.count("*").alias("occurrences"))
    )
    marked, bare = keys.filter("NOT simple AND with_runs"), keys.filter("NOT simple AND NOT with_runs AND key <> ''")
    found = None
    if not marked.isEmpty():
        named = lambda d, c: d.withColumn("shown", F.col(c))
        found = _looked_up(named(text, "norm"), named(marked, "key"), runs("shown"))
    if not bare.isEmpty():
        # each run of other characters is a text of its own here, so no gram spans a token
        others = text.select(*PAGE, "span_no", F.explode(F.array_distinct(F.regexp_extract_all("norm", F.lit(rest), 0))).alias("shown"))
        more = _looked_up(others, bare.withColumn("shown", F.col("key")), F.split("shown", "")).distinct()
        found = more if found is None else found.unionByName(more)
    if found is None:
        return plain
    places = found.join(_shuffled(text), [*PAGE, "span_no"])
    counted = places.select(*PAGE, "span_no", "key", _occurrences(F.col("norm"), F.col("key")).alias("occurrences"))
    return plain.unionByName(counted.filter("occurrences > 0"))


def anchored_values(spans: DataFrame, setup: Setup) -> DataFrame:
    """(doc_id, page, span_no, rule_no, value): the text after a label; rule_no -1 is the key label."""
    labels = [(i, f.anchor) for i, f in enumerate(setup.fields)]
    if setup.key_anchor:
        labels.append((-1, setup.key_anchor))
    norm = F.col("norm")
    found = []
    for no, anchor in labels:
        import unicodedata

        label = unicodedata.normalize("NFC", anchor).strip()
        value = js_trim(F.substr(norm, F.lit(len(label) + 1)))
        found.append(F.when(norm.startswith(label), F.struct(F.lit(no).alias("rule_no"), value.alias("value"))))
    rows = F.filter(F.array(*found), lambda x: x.isNotNull())
    return normalized_spans(spans).select(*PAGE, "span_no", F.inline(rows))


def assign_pages(pages: DataFrame, hits: DataFrame, anchors: DataFrame, setup: Setup) -> DataFrame:
    """(doc_id, page, key, n_candidates, ambiguous): the one record a page belongs to, or NULL."""
    per_key = hits.groupBy(*PAGE, "key").agg(F.sum("occurrences").alias("occ"))
    per_page = per_key.groupBy(*PAGE).agg(
        F.count("*").alias("n_candidates"), F.max("key").alias("sole"), F.sum("occ").alias("occ")
    )
    d = pages.select(*PAGE).join(per_page, PAGE, "left")
    one = F.col("n_candidates") == 1
    if setup.key_anchor:
        exact = (
            anchors.filter("rule_no = -1").groupBy(*PAGE, F.col("value").alias("sole"))
            .agg(F.count("*").alias("n_anchor"))
        )
        d = d.join(exact, [*PAGE, "sole"], "left")
        chosen = one & (F.coalesce(F.col("n_anchor"), F.lit(0)) == 1)
    else:
        chosen = one & (F.col("occ") == 1)
    d = d.withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0).cast("bigint")))
    d = d.withColumn("key", F.when(F.coalesce(chosen, F.lit(False)), F.col("sole")))
    return d.select(
        *PAGE, "key", "n_candidates", (F.col("key").isNull() & (F.col("n_candidates") > 0)).alias("ambiguous")
    )


def compare_fields(assigned: DataFrame, records: DataFrame, anchors: DataFrame, setup: Setup) -> DataFrame:
    """(doc_id, page, key, rule_no, column, expected, observed, n_observed, status) per assigned page and rule."""
    expected = records.select(
        F.col("norm_key").alias("key"),
        F.inline(F.array(*[
            F.struct(F.lit(i).alias("rule_no"), F.lit(f.column).alias("column"),
                     F.col("cells")[f.column].alias("expected"))
            for i, f in enumerate(setup.fields)
        ])),
    )
    seen = anchors.filter("rule_no >= 0").groupBy(*PAGE, "rule_no").agg(
        F.count("*").alias("n_observed"), F.min_by("value", "span_no").alias("observed")
    )
    d = (
        assigned.filter("key IS NOT NULL").select(*PAGE, "key").join(expected, "key")
        .join(seen, [*PAGE, "rule_no"], "left")
        .withColumn("wanted", normalize_text("expected"))
    )
    same = F.lit(False)
    for i, f in enumerate(setup.fields):
        if f.mode == "exact":
            test = F.col("wanted") == F.col("observed")
        else:
            test = decimal_key("wanted", f.number) == decimal_key("observed", f.number)
        same = F.when(F.col("rule_no") == i, F.coalesce(test, F.lit(False))).otherwise(same)
    n = F.coalesce(F.col("n_observed"), F.lit(0).cast("bigint"))
    status = (
        F.when(n > 1, "AMBIGUOUS FIELD")
        .when((n == 0) | (F.col("observed") == ""), "FIELD MISSING")
        .when(same, "PASS").otherwise("FIELD MISMATCH")
    )
    return d.select(
        *PAGE, "key", "rule_no", "column", "expected", F.coalesce("observed", F.lit("")).alias("observed"),
        n.alias("n_observed"), status.alias("status"),
    )


def page_status(pages: DataFrame, assigned: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc_id, page, key, n_candidates, blank, status) with the fixed precedence of page verdicts."""
    verdict = fields.groupBy(*PAGE).agg(F.bool_and(F.col("status") == "PASS").alias("all_pass"))
    blank = F.col("blank") if "blank" in pages.columns else F.lit(False)
    d = (
        pages.select(*PAGE, "visibility_review", blank.alias("blank"))
        .join(assigned, PAGE).join(verdict, PAGE, "left")
    )
    # Missing inspection is a review, never a pass.
    hidden = F.coalesce(F.col("visibility_review"), F.lit(True))
    status = (
        F.when(hidden, "UNSUPPORTED VISIBILITY / REVIEW").when(F.col("ambiguous"), "AMBIGUOUS KEY")
        .when(F.col("key").isNull(), "UNRESOLVED OUTPUT PAGE")
        .when(F.coalesce("all_pass", F.lit(True)), "PASS").otherwise("FIELD REVIEW")
    )
    return d.select(*PAGE, "key", "n_candidates", "blank", status.alias("status"))


def source_status(records: DataFrame, page_findings: DataFrame, hits: DataFrame) -> DataFrame:
    """(record_no, key, n_pages, status) per source record."""
    per_key = page_findings.filter("key IS NOT NULL").groupBy("key").agg(
        F.count("*").alias("n_pages"), F.bool_and(F.col("status") == "PASS").alias("passed")
    )
    open_pages = page_findings.filter("key IS NULL").select(*PAGE)
    uncertain = hits.join(open_pages, PAGE, "left_semi").select("key").distinct().withColumn("uncertain", F.lit(True))
    d = (
        records.select("record_no", F.col("norm_key").alias("key"))
        .join(per_key, "key", "left").join(uncertain, "key", "left")
    )
    n = F.coalesce(F.col("n_pages"), F.lit(0).cast("bigint"))
    status = (
        F.when(n > 1, "DUPLICATE OUTPUT RECORD").when(F.coalesce("uncertain", F.lit(False)), "REVIEW")
        .when(n == 0, "MISSING OUTPUT RECORD").when(F.col("passed"), "PASS").otherwise("REVIEW")
    )
    return d.select("record_no", "key", n.alias("n_pages"), status.alias("status"))


def reconciliation_summary(sources: DataFrame, page_findings: DataFrame) -> DataFrame:
    """Eleven counters; the query fails when either accounting equation does not hold."""
    tally = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, 1).otherwise(0)), F.lit(0)).cast("bigint")
    total = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    a = sources.agg(
        F.count("*").alias("source_records"), tally("PASS").alias("passed_records"),
        (tally("REVIEW") + tally("DUPLICATE OUTPUT RECORD")).alias("failed_or_review_records"),
        tally("MISSING OUTPUT RECORD").alias("missing_records"),
        F.coalesce(F.sum(F.greatest(F.lit(0), F.col("n_pages") - 1)), F.lit(0)).cast("bigint").alias("duplicate_instances"),
    )
    open_, named = F.col("key").isNull(), F.col("n_candidates") > 0
    b = page_findings.agg(
        total(open_ & ~named).alias("unresolved_pages"), total(F.col("blank")).alias("blank_pages"),
        total(open_ & named).alias("ambiguous_pages"), total(~open_).alias("assigned_pages"),
        F.count("*").alias("output_pages"),
        tally("UNSUPPORTED VISIBILITY / REVIEW").alias("visibility_review_pages"),
    )
    # Two one-row frames: the join key is a constant.
    d = a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one").drop("one")
    balanced = (
        F.col("source_records")
        == F.col("passed_records") + F.col("failed_or_review_records") + F.col("missing_records")
    ) & (F.col("output_pages") == F.col("assigned_pages") + F.col("unresolved_pages") + F.col("ambiguous_pages"))
    checked = F.when(balanced, F.col("source_records")).otherwise(
        F.raise_error(F.lit("reconciliation accounting does not balance")).cast("bigint")
    )
    return d.withColumn("source_records", checked)


def source_outcome(sources: DataFrame, page_findings: DataFrame, fields: DataFrame, hits: DataFrame) -> DataFrame:
    """(record_no, key, outcome): the first cause for every record that is under review."""
    named = page_findings.filter("key IS NOT NULL").select(*PAGE, "key", "status").unionByName(
        hits.select(*PAGE, "key").distinct()
        .join(page_findings.filter("key IS NULL").select(*PAGE, "status"), PAGE)
        .select(*PAGE, "key", "status")
    )
    # A page assigned to one record cannot name another (one candidate only), so the union is complete.
    page_cause = named.groupBy("key").agg(
        F.bool_or(F.col("status") == "UNSUPPORTED VISIBILITY / REVIEW").alias("hidden"),
        F.bool_or(F.col("status") == "AMBIGUOUS KEY").alias("ambiguous"),
    )
    field_cause = fields.filter("status <> 'PASS'").groupBy("key").agg(
        F.min_by("status", F.struct(*PAGE, "rule_no")).alias("field_status")
    )
    d = sources.join(page_cause, "key", "left").join(field_cause, "key", "left")
    outcome = (
        F.when(F.col("status") != "REVIEW", F.col("status")).when(F.col("hidden"), "VISIBILITY REVIEW")
        .when(F.col("ambiguous"), "AMBIGUOUS KEY").otherwise(F.coalesce("field_status", F.lit("REVIEW")))
    )
    return d.select("record_no", "key", outcome.alias("outcome"))


def blank_pages(items: DataFrame, operators: DataFrame) -> DataFrame:
    """(doc_id, page, blank): no non-blank text and only non-painting instructions."""
    text = items.groupBy(*PAGE).agg(F.bool_or(~is_blank("text")).alias("has_text"))
    ops = operators.groupBy(*PAGE).agg(F.bool_and(F.col("op").isin(*NON_PAINTING)).alias("only_state"))
    d = ops.join(text, PAGE, "full_outer")
    return d.select(
        *PAGE, (~F.coalesce("has_text", F.lit(False)) & F.coalesce("only_state", F.lit(True))).alias("blank")
    )


def records_from(df: DataFrame, key_column: str, record_no: str = "record_no") -> DataFrame:
    """(record_no, key, norm_key, cells) from a wide all-string table."""
    names = [c for c in df.columns if c != record_no]
    pairs = [x for c in names for x in (F.lit(c), F.col(c))]
    return df.select(
        F.col(record_no).alias("record_no"), F.col(key_column).alias("key"),
        normalize_text(key_column).alias("norm_key"), F.create_map(*pairs).alias("cells"),
    )
