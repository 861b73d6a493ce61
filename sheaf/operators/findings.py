"""Object-graph inspection: findings, grouping, removal and before/after verification.

``objects(doc_id, obj_id, path, attrs MAP)``, ``edges(doc_id, src, dst, key)``, ``roots(doc_id, node)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sheaf.functions import graphs
from sheaf.session import stage

# Fixed values.
CATEGORIES = (
    "metadata", "xmp", "attachment", "active-content", "annotation", "external-link",
    "form", "hidden-text", "redaction-risk", "optional-content", "thumbnail", "image-metadata",
)
PARTIAL = ("redaction-risk", "image-metadata", "xmp")
INSPECT_ONLY = ("form", "hidden-text", "optional-content", "thumbnail")
STANDARD_INFO = (
    "Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate", "Trapped",
)
REVIEW_SUBTYPES = (
    "Text", "FreeText", "Highlight", "Underline", "StrikeOut", "Squiggly", "Stamp", "Ink",
    "Caret", "Circle", "Square", "Line", "Polygon", "PolyLine", "Popup",
)
PRESERVED_SUBTYPES = (
    "Link", "Widget", "FileAttachment", "Screen", "Movie", "Sound", "PrinterMark", "TrapNet",
    "Watermark", "3D", "RichMedia", "Redact", "Projection",
)
GROUPS = (
    ("metadata", True), ("attachments", True), ("activeContent", True), ("comments", True), ("externalLinks", True),
    ("forms", False), ("hiddenText", False), ("redactionRisk", False), ("layersOther", False),
)
STATUS_ORDER = {"verified-removed": 0, "could-not-verify": 1, "removal-failed": 2}


def has(key: str) -> Column:
    return F.map_contains_key("attrs", key)


def at(key: str) -> Column:
    return F.col("attrs")[key]


def is_signed() -> Column:
    return has("ByteRange") | F.coalesce(at("FT") == "Sig", F.lit(False)) | F.coalesce(at("Type") == "Sig", F.lit(False))


def dangerous() -> Column:
    """Launch, JavaScript or NULL: the kind of an executable action."""
    return F.when(at("S") == "Launch", "Launch").when((at("S") == "JavaScript") | has("JS"), "JavaScript")


def is_uri() -> Column:
    return F.coalesce(at("S") == "URI", F.lit(False))


def reachability(objects: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """objects + ``depth`` (NULL when no root leads there)."""
    seen = graphs.closure(roots, edges, ["doc_id"], max_depth)
    return objects.join(seen.select("doc_id", F.col("node").alias("obj_id"), "depth"), ["doc_id", "obj_id"], "left")


def classify_objects(objects: DataFrame) -> DataFrame:
    """(doc_id, obj_id, rule_no, category, title, concern, confidence, removal, path, evidence MAP).

    One object may give several findings; evidence holds whole values."""
    def finding(rule, test, category, title, concern, evidence, removal="supported-later", confidence="high"):
        lit = lambda v: F.lit(v) if isinstance(v, str) else v
        pairs = [x for k, v in evidence.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))]
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        return F.when(test, F.array(F.struct(
            F.lit(rule).alias("rule_no"), F.lit(category).alias("category"), lit(title).alias("title"),
            lit(concern).alias("concern"), F.lit(confidence).alias("confidence"), lit(removal).alias("removal"),
            (F.create_map(*pairs) if pairs else none).alias("evidence"))))

    info = F.transform(
        F.filter(F.map_entries("attrs"), lambda e: e["value"] != ""),
        lambda e: F.struct(
            F.lit(0).alias("rule_no"), F.lit("metadata").alias("category"),
            F.when(e["key"].isin(*STANDARD_INFO), F.concat(e["key"], F.lit(" metadata"))).otherwise("Custom Info metadata").alias("title"),
            F.when(e["key"] == "Author", "review").otherwise("informational").alias("concern"), F.lit("high").alias("confidence"),
            F.lit("supported-later").alias("removal"),
            F.create_map(F.lit("key"), e["key"], F.lit("value"), e["value"]).alias("evidence")))
    root = F.col("path") == "trailer/Root"
    sub = at("Subtype")
    widget = sub == "Widget"
    noted = sub.isin(*REVIEW_SUBTYPES, "Link", "FileAttachment", "Widget") & (at("Type") == "Annot")
    rules = [
        F.when(F.col("path") == "trailer/Info", info),
        finding(1, (F.col("path") == "trailer/Root/Metadata") & (at("Type") == "Metadata"), "xmp", "XMP metadata stream", "review", {}),
        finding(2, (at("Type") == "Filespec") | has("EF"), "attachment", "Embedded file reference", "high",
                {"filename": F.coalesce(at("UF"), at("F"), F.lit("Unnamed"))}),
        finding(3, dangerous().isNotNull(), "active-content", F.concat(dangerous(), F.lit(" action")), "high", {"action": dangerous()}),
        finding(4, root & has("OpenAction"), "active-content", "OpenAction entry", "review", {}),
        finding(5, has("AA"), "active-content", "Additional action triggers", "review", {}),
        finding(6, is_uri(), "external-link", "External URI action", "review", {"target": F.coalesce(at("URI"), F.lit("Unspecified"))}),
        finding(7, noted, "annotation", F.when(widget, "Form widget").otherwise(F.concat(sub, F.lit(" annotation"))),
                F.when(widget, "informational").otherwise("review"), {"subtype": sub, "summary": at("Contents")},
                F.when(widget, "inspect-only").otherwise("supported-later")),
        finding(8, root & has("AcroForm"), "form", "AcroForm present", "informational", {}, "inspect-only"),
        finding(9, F.contains("path", F.lit("/Fields/")) & (has("T") | has("FT")), "form", "Form field",
                F.when(has("V") | has("DV"), "review").otherwise("informational"),
                {"name": F.coalesce(at("T"), F.lit("Unnamed")), "type": F.coalesce(at("FT"), F.lit("Inherited"))}, "inspect-only"),
        finding(10, root & has("OCProperties"), "optional-content", "Optional PDF layers", "review", {}, "inspect-only"),
        finding(11, has("Thumb"), "thumbnail", "Embedded page thumbnail", "review", {}, "inspect-only"),
    ]
    per_object = objects.select(
        "doc_id", "obj_id", "path", F.inline(F.flatten(F.filter(F.array(*rules), lambda x: x.isNotNull()))))
    images = objects.filter(at("Subtype") == "Image").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum((has("Metadata") | has("ICCProfile")).cast("bigint")).alias("m"))
    per_document = images.select(
        "doc_id", F.lit(-1).cast("bigint").alias("obj_id"), F.lit("").alias("path"), F.lit(12).alias("rule_no"),
        F.lit("image-metadata").alias("category"), F.lit("Embedded images inventoried").alias("title"),
        F.lit("informational").alias("concern"), F.lit("medium").alias("confidence"), F.lit("inspect-only").alias("removal"),
        F.create_map(F.lit("images"), F.col("n").cast("string"), F.lit("with_metadata"), F.col("m").cast("string")).alias("evidence"))
    return per_object.unionByName(per_document)


def structure_counts(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Counters per document for attachments, dangerous and outside actions, and annotations.

    An entry counts when its chain of Next actions holds such an action anywhere, so the actions are
    propagated backwards along the chains first."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    sub = at("Subtype")
    annotation = at("Type") == "Annot"
    base = objects.groupBy("doc_id").agg(
        n(at("Type") == "Filespec").alias("file_specs"), n(has("EF")).alias("ef_dictionaries"),
        n(has("AF")).alias("associated_files"), n(sub == "FileAttachment").alias("file_annotations"),
        n(dangerous().isNotNull()).alias("dangerous_actions"), n(is_uri()).alias("uri_actions"),
        n(annotation & sub.isin(*REVIEW_SUBTYPES)).alias("review_annotations"), n(annotation & (sub == "Popup")).alias("popups"),
        n(annotation & sub.isin(*PRESERVED_SUBTYPES)).alias("preserved_annotations"),
        n(annotation & ~F.coalesce(sub, F.lit("")).isin(*REVIEW_SUBTYPES, *PRESERVED_SUBTYPES)).alias("ambiguous_annotations"),
    )
    backward = edges.filter("key = 'Next'").select("doc_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    out = base
    for name, test in (("dangerous", dangerous().isNotNull()), ("uri", is_uri())):
        holds = graphs.closure(objects.filter(test).select("doc_id", F.col("obj_id").alias("node")), backward, ["doc_id"])
        entries = edges.filter("key IN ('OpenAction', 'A', 'AA', 'Next')").join(
            holds.select("doc_id", F.col("node").alias("dst")), ["doc_id", "dst"], "left_semi")
        counted = entries.groupBy("doc_id").agg(
            n(F.col("key") == "OpenAction").alias(f"{name}_open_actions"), n(F.col("key") == "A").alias(f"{name}_entries"),
            n(F.col("key") == "AA").alias(f"{name}_additional"), n(F.col("key") == "Next").alias(f"{name}_next"))
        out = out.join(counted, "doc_id", "left")
    return out.na.fill(0)


def finding_group() -> Column:
    review_note = (F.col("category") == "annotation") & F.col("evidence")["subtype"].isin(*REVIEW_SUBTYPES)
    widget = (F.col("category") == "annotation") & (F.col("evidence")["subtype"] == "Widget")
    c = F.col("category")
    return (
        F.when(c.isin("metadata", "xmp"), "metadata").when(c == "attachment", "attachments")
        .when((c == "active-content") & F.col("title").isin("JavaScript action", "Launch action"), "activeContent")
        .when(F.coalesce(review_note, F.lit(False)), "comments").when(c == "external-link", "externalLinks")
        .when((c == "form") | F.coalesce(widget, F.lit(False)), "forms").when(c == "hidden-text", "hiddenText")
        .when(c == "redaction-risk", "redactionRisk").when(c.isin("optional-content", "thumbnail", "image-metadata", "annotation"), "layersOther")
    )


def group_findings(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, group, supported, n): nine groups for every document, empty ones with 0."""
    counts = findings.withColumn("group", finding_group()).filter("group IS NOT NULL").groupBy("doc_id", "group").agg(F.count("*").alias("n"))
    dimension = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(s).alias("supported")) for g, s in GROUPS])
    every = docs.select("doc_id", F.inline(dimension))
    return every.join(counts, ["doc_id", "group"], "left").na.fill(0, ["n"])


def coverage_matrix(docs: DataFrame) -> DataFrame:
    state = lambda c: "partial" if c in PARTIAL else "inspection-only" if c in INSPECT_ONLY else "inspected"
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(state(c)).alias("state")) for c in CATEGORIES])
    return docs.select("doc_id", F.inline(rows))


def default_selection(groups: DataFrame) -> DataFrame:
    """Pre-selected removals per document: metadata, attachments and active content when present."""
    some = lambda g: F.max(F.when(F.col("group") == g, F.col("n")).otherwise(0)) > 0
    return groups.groupBy("doc_id").agg(
        some("metadata").alias("metadata"), some("attachments").alias("attachments"),
        some("activeContent").alias("activeContent"),
    ).withColumns({"comments": F.lit(False), "externalLinks": F.lit(False)})


def _chosen(objects: DataFrame, selection: DataFrame) -> DataFrame:
    return objects.join(selection, "doc_id", "left")


def removed_comments(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, obj_id) of review marks, their popups and everything that replies to them."""
    seeds = objects.filter((at("Type") == "Annot") & at("Subtype").isin(*REVIEW_SUBTYPES)).select("doc_id", F.col("obj_id").alias("node"))
    follow = edges.filter("key = 'Popup'").select("doc_id", "src", "dst").unionByName(
        edges.filter("key IN ('Parent', 'IRT')").select("doc_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graphs.closure(seeds, follow, ["doc_id"]).select("doc_id", F.col("node").alias("obj_id"))


def removed_attachments(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, obj_id) of file attachments with popups that no surviving annotation shares."""
    notes = objects.filter(at("Type") == "Annot").select("doc_id", "obj_id", at("Subtype").alias("subtype"))
    popups = notes.filter("subtype = 'Popup'").select("doc_id", F.col("obj_id").alias("popup"))
    owners = edges.filter("key = 'Popup'").select("doc_id", F.col("src").alias("owner"), F.col("dst").alias("popup"))
    parents = edges.filter("key = 'Parent'").select("doc_id", F.col("dst").alias("owner"), F.col("src").alias("popup"))
    removed = stage(notes.filter("subtype = 'FileAttachment'").select("doc_id", "obj_id"))
    links = stage(owners.unionByName(parents).distinct())
    keepers = stage(owners.join(notes.filter("subtype <> 'Popup'").select("doc_id", F.col("obj_id").alias("owner")), ["doc_id", "owner"], "left_semi"))
    while True:
        gone = removed.select("doc_id", F.col("obj_id").alias("owner"))
        touched = links.join(gone, ["doc_id", "owner"], "left_semi").select("doc_id", "popup").distinct()
        shared = keepers.join(gone, ["doc_id", "owner"], "left_anti").select("doc_id", "popup")
        new = touched.join(popups, ["doc_id", "popup"], "left_semi").join(shared, ["doc_id", "popup"], "left_anti")
        new = stage(new.select("doc_id", F.col("popup").alias("obj_id")).join(removed, ["doc_id", "obj_id"], "left_anti"))
        if new.isEmpty():
            return removed
        removed = removed.unionByName(new)


def remove_findings(objects: DataFrame, edges: DataFrame, roots: DataFrame, selection: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, edges) without the selected kinds.

    ``selection(doc_id, metadata, attachments, activeContent, comments, externalLinks)``. Links to removed
    objects go; a removed outside action hands its place to the next kept action of its chain; what no
    root reaches any more is dropped."""
    on = lambda k: selection.filter(F.col(k)).select("doc_id")
    pick = lambda test, k: objects.filter(test).join(on(k), "doc_id", "left_semi").select("doc_id", "obj_id")
    gone = pick((F.col("path") == "trailer/Info") | (F.col("path") == "trailer/Root/Metadata"), "metadata")
    gone = gone.unionByName(pick(dangerous().isNotNull(), "activeContent"))
    gone = gone.unionByName(pick((at("Type") == "Filespec") | has("EF"), "attachments"))
    gone = gone.unionByName(removed_attachments(objects, edges).join(on("attachments"), "doc_id", "left_semi"))
    gone = gone.unionByName(removed_comments(objects, edges).join(on("comments"), "doc_id", "left_semi"))
    uris = stage(pick(is_uri(), "externalLinks"))
    gone = stage(gone.unionByName(uris).distinct())
    id_ = lambda n: gone.select("doc_id", F.col("obj_id").alias(n))
    promoted = graphs.successors_outside(
        uris.select("doc_id", F.col("obj_id").alias("node")), edges.filter("key = 'Next'"), ["doc_id"])
    rewired = (
        edges.filter("key IN ('OpenAction', 'A', 'AA', 'Next')").withColumnRenamed("dst", "node")
        .join(promoted, ["doc_id", "node"]).select("doc_id", "src", F.col("kept").alias("dst"), "key"))
    kept_edges = edges.unionByName(rewired).join(id_("src"), ["doc_id", "src"], "left_anti").join(id_("dst"), ["doc_id", "dst"], "left_anti")
    kept_edges = stage(kept_edges.select("doc_id", "src", "dst", "key").distinct())
    kept = objects.join(gone, ["doc_id", "obj_id"], "left_anti")
    alive = reachability(kept, kept_edges, roots).filter("depth IS NOT NULL").drop("depth")
    return stage(alive), kept_edges


def contains_secret(text: Column, secret: Column) -> Column:
    """Plain, or as hexadecimal UTF-8 or UTF-16 in either letter case."""
    low = F.lower(text)
    hexed = lambda charset: F.lower(F.hex(F.encode(secret, charset)))
    return F.contains(text, secret) | F.contains(low, hexed("UTF-8")) | F.contains(low, hexed("UTF-16BE"))


def verify_removal(
    docs: DataFrame, after_groups: DataFrame, after_pages: DataFrame, serialized: DataFrame, secrets: DataFrame, selection: DataFrame
) -> DataFrame:
    """(doc_id, step, before, after, residual, status) for every selected kind.

    ``docs(doc_id, pages)`` before; ``after_pages(doc_id, pages)`` after (missing = could not inspect);
    ``serialized(doc_id, content)`` after; ``secrets(doc_id, step, secret)``, tested from 4 characters up;
    ``after_groups(doc_id, group, before, n)``."""
    kinds = ("metadata", "attachments", "activeContent", "comments", "externalLinks")
    steps = selection.select("doc_id", F.explode(F.filter(
        F.array(*[F.when(F.col(k), F.lit(k)) for k in kinds]), lambda x: x.isNotNull())).alias("step"))
    hit = secrets.filter(F.length("secret") >= 4).join(serialized, "doc_id").filter(contains_secret(F.col("content"), F.col("secret")))
    residual = hit.groupBy("doc_id", "step").agg(F.count("*").alias("residual"))
    d = (
        steps.join(after_groups.withColumnRenamed("group", "step"), ["doc_id", "step"], "left")
        .join(residual, ["doc_id", "step"], "left").join(docs.select("doc_id", "pages"), "doc_id", "left")
        .join(after_pages.select("doc_id", F.col("pages").alias("pages_after")), "doc_id", "left")
    )
    failed = (F.col("n") > 0) | (F.coalesce("residual", F.lit(0)) > 0) | (F.col("pages") != F.col("pages_after"))
    status = (
        F.when(F.col("pages_after").isNull() | F.col("n").isNull(), "could-not-verify")
        .when(failed, "removal-failed").otherwise("verified-removed"))
    return d.select("doc_id", "step", "before", F.col("n").alias("after"),
                    F.coalesce("residual", F.lit(0).cast("bigint")).alias("residual"), status.alias("status"))


def combine_status(steps: DataFrame) -> DataFrame:
    """Worst status per document."""
    rank = F.create_map(*[x for k, v in STATUS_ORDER.items() for x in (F.lit(k), F.lit(v))])
    return steps.groupBy("doc_id").agg(
        F.max_by("status", rank[F.col("status")]).alias("status"), F.sum("before").alias("before"), F.sum("after").alias("after"))
