"""Findings, removal, visibility, redaction and policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.fixtures import ctes, load
from sheaf.functions import ordered
from sheaf.operators import findings as f, policy as p, visibility as v
from sheaf.session import stage
from sheaf.sources import markup


def _objects(s, sf):
    return stage(markup.html_objects(load(s, sf, "fx_risky_pages")))


def _graph(objects):
    """Document edges plus actions in order: every action is an entry, and leads to the next one unless
    its number is a multiple of three."""
    edges, roots = markup.document_edges(objects)
    actions = objects.filter("attrs['S'] IS NOT NULL").select("doc_id", "obj_id")
    seq = ordered.with_previous(actions, ["doc_id"], ["obj_id"], ["obj_id"])
    nexts = seq.filter("prev.obj_id % 3 <> 0").select("doc_id", F.col("prev.obj_id").alias("src"), F.col("obj_id").alias("dst"), F.lit("Next").alias("key"))
    entries = actions.select("doc_id", F.lit(-1).cast("bigint").alias("src"), F.col("obj_id").alias("dst"), F.lit("A").alias("key"))
    return stage(edges.unionByName(nexts).unionByName(entries)), roots


def _selection(objects):
    d = objects.select("doc_id").distinct()
    m = lambda n: F.col("doc_id") % n == 0
    return d.select("doc_id", m(3).alias("metadata"), m(6).alias("attachments"), (F.col("doc_id") % 4 != 0).alias("activeContent"),
                    F.lit(False).alias("comments"), m(2).alias("externalLinks"))


def _docs(objects):
    return objects.select("doc_id").distinct()


def _fk_graph(s, sf):
    """Regions, nations, customers and orders as one graph; nation 7 hangs on nothing."""
    node = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    edge = lambda df, a, ka, b, kb: df.select(F.lit(0).alias("doc_id"), node(a, ka).alias("src"), node(b, kb).alias("dst"))
    n, c, o = (load(s, sf, t) for t in ("nation", "customer", "orders"))
    edges = edge(n.filter("n_nationkey <> 7"), "r", "n_regionkey", "n", "n_nationkey").unionByName(
        edge(c, "n", "c_nationkey", "c", "c_custkey")).unionByName(edge(o, "c", "o_custkey", "o", "o_orderkey"))
    objects = [t.select(F.lit(0).alias("doc_id"), node(a, k).alias("obj_id")) for t, a, k in (
        (load(s, sf, "region"), "r", "r_regionkey"), (n, "n", "n_nationkey"), (c, "c", "c_custkey"), (o, "o", "o_orderkey"))]
    roots = objects[0].withColumnRenamed("obj_id", "node")
    every = objects[0].unionByName(objects[1]).unionByName(objects[2]).unionByName(objects[3])
    return f.reachability(every, edges, roots).select("obj_id", F.coalesce("depth", F.lit(-1)).alias("depth"))


def _findings_out(s, sf):
    d = f.classify_objects(_objects(s, sf))
    detail = F.coalesce(F.col("evidence")["value"], F.col("evidence")["target"], F.col("evidence")["summary"], F.col("evidence")["filename"],
                        F.col("evidence")["images"], F.col("evidence")["name"], F.lit(""))
    return d.select("doc_id", "obj_id", "category", "title", "concern", "removal", detail.alias("detail"))


def _groups(s, sf):
    o = _objects(s, sf)
    return f.group_findings(_docs(o), f.classify_objects(o))


def _removed(s, sf):
    o = _objects(s, sf)
    edges, roots = _graph(o)
    return f.remove_findings(o, edges, roots, _selection(o))


def _replies(s, sf):
    c = load(s, sf, "conversations")
    note = F.when((F.col("turn") == 1) & (F.col("conv_id") % 4 == 0), "Text").otherwise("Link")
    objects = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("obj_id"), F.create_map(
        F.lit("Type"), F.lit("Annot"), F.lit("Subtype"), note).alias("attrs"))
    edges = c.filter("turn > 0").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("src"), (F.col("turn") - 1).alias("dst"), F.lit("IRT").alias("key"))
    return f.removed_comments(objects, edges)


def _verified(s, sf):
    pages = load(s, sf, "fx_risky_pages")
    o = _objects(s, sf)
    edges, roots = _graph(o)
    chosen = stage(_selection(o))
    after, _ = f.remove_findings(o, edges, roots, chosen)
    docs = _docs(o).withColumn("pages", F.lit(1))
    before = f.group_findings(docs, f.classify_objects(o)).withColumnRenamed("n", "before")
    later = f.group_findings(docs, f.classify_objects(after)).join(before.select("doc_id", "group", "before"), ["doc_id", "group"])
    # Every fifth page keeps its links in the written text; every eleventh cannot be inspected again.
    text = pages.select(F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 5 == 0, F.col("html")).otherwise(
        F.regexp_replace("html", "https?://", "removed:")).alias("content"))
    secrets = o.filter("attrs['S'] = 'URI'").select("doc_id", F.lit("externalLinks").alias("step"), F.col("attrs")["URI"].alias("secret")).distinct()
    return f.verify_removal(docs, later, docs.filter("doc_id % 11 <> 0"), text, secrets, chosen)


def _redaction(s, sf):
    d = load(s, sf, "documents")
    docs = d.select("doc_id", "text", (F.col("doc_id") % 19 == 0).alias("signed"), F.lit(False).alias("has_form"), F.lit(False).alias("has_layers"))
    text, receipt = p.redact(docs, load(s, sf, "fx_marks").withColumnRenamed("end_", "end"))
    return text.select("doc_id", F.md5("text").alias("text")).join(receipt.drop("selection_key"), "doc_id")


def _mark_problems(s, sf):
    d = load(s, sf, "documents")
    docs = d.select("doc_id", "text", (F.col("doc_id") % 19 == 0).alias("signed"), F.lit(False).alias("has_form"), F.lit(False).alias("has_layers"))
    return p.mark_problems(docs, load(s, sf, "fx_marks").withColumnRenamed("end_", "end"))


def _requirements(docs):
    """One row per policy found in the documents."""
    n = F.col("policy")
    return docs.select("policy").distinct().select(
        "policy", F.when(n == "p0", 0.002).when(n == "p2", 1.0).alias("max_mb"), F.when(n == "p0", 10).when(n == "p2", 1000).alias("max_pages"),
        F.when(n == "p0", "letter").when(n == "p2", "a4").otherwise("any").alias("page_size"), (n != "p1").alias("no_active"))


def _checks(s, sf):
    docs = load(s, sf, "fx_policy_docs")
    return p.preflight(docs, load(s, sf, "fx_policy_pages"), _requirements(docs))


def _plan(s, sf):
    docs = load(s, sf, "fx_policy_docs")
    optional = docs.select("doc_id", F.lit("Metadata and XMP").alias("label"), "active_actions").withColumnRenamed("active_actions", "n")
    return p.preflight_plan(_checks(s, sf), optional)


def _approved(s, sf):
    docs = load(s, sf, "fx_policy_docs")
    approvals = docs.select("doc_id", (F.col("doc_id") % 3 == 0).alias("remove_active"), (F.col("doc_id") % 2 == 0).alias("optimize"))
    return p.apply_approved(docs, approvals).drop("saved_percent")


def _attrs(s, sf):
    pairs = F.transform(F.map_entries("attrs"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return markup.html_objects(load(s, sf, "fx_risky_pages")).select("doc_id", "obj_id", "tag", "path", F.array_join(F.array_sort(pairs), ";").alias("attrs"))


def _structures(s, sf):
    o = _objects(s, sf)
    return f.structure_counts(o, _graph(o)[0])


QUERIES = {
    "k2_html_objects": _attrs,
    "f1_reachability": _fk_graph,
    "f2_classify_objects": _findings_out,
    "f3_structure_counts": _structures,
    "f4_covered_text": lambda s, sf: v.covered_text(load(s, sf, "fx_words"), load(s, sf, "fx_covers")),
    "f5_offpage_text": lambda s, sf: v.offpage_text(load(s, sf, "fx_words"), load(s, sf, "fx_word_pages")),
    "f6_hidden_text_class": lambda s, sf: v.hidden_text_class(load(s, sf, "fx_words"), load(s, sf, "fx_word_pages")),
    "f7_group_findings": _groups,
    "f8_coverage_matrix": lambda s, sf: f.coverage_matrix(load(s, sf, "pages").select(F.col("page_id").alias("doc_id"))),
    "f9_default_selection": lambda s, sf: f.default_selection(_groups(s, sf)),
    "f10_remove_findings": lambda s, sf: _removed(s, sf)[0].select("doc_id", "obj_id", "path"),
    "f10_kept_entries": lambda s, sf: _removed(s, sf)[1].filter("key = 'A'").select("doc_id", "dst"),
    "f10_removed_replies": _replies,
    "f11_verify_removal": _verified,
    "f12_combine_status": lambda s, sf: f.combine_status(_verified(s, sf)),
    "f13_redact": _redaction,
    "f13_mark_problems": _mark_problems,
    "f14_preflight": _checks,
    "f15_preflight_plan": _plan,
    "f16_apply_approved": _approved,
}

_ATTR = lambda n: f"""CASE WHEN tag = '#comment' THEN '' ELSE regexp_extract(raw, '(?is)\\s{n}\\s*=\\s*["'']([^"'']*)["'']', 1) END"""
_OBJ = r"""raw AS (SELECT page_id AS doc_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS obj_id FROM (SELECT page_id, regexp_extract_all(
      regexp_replace(html, '(?is)(<script\b[^>]*>).*?</script>', '\1', 'g'), '(?is)<!--.*?-->|<title\b[^>]*>[^<]*|<[a-z][^>]*>') AS l FROM fx_risky_pages)),
    tagged AS (SELECT *, CASE WHEN starts_with(raw, '<!--') THEN '#comment' ELSE lower(regexp_extract(raw, '^<([A-Za-z][A-Za-z0-9]*)', 1)) END AS tag FROM raw),
    o AS (SELECT doc_id, obj_id, tag, """ + ", ".join(f"{_ATTR(n)} AS {n}_" for n in ("href", "src", "name", "content", "value", "type")) + r""",
      CASE WHEN tag = '#comment' THEN trim(regexp_replace(raw, '^<!--|-->$', '', 'g')) ELSE trim(regexp_replace(raw, '^<[^>]*>', '')) END AS own FROM tagged),
    k AS (SELECT *, tag = 'a' AND regexp_matches(href_, '(?i)^https?:') AS uri, upper(left(name_, 1)) || lower(substr(name_, 2)) AS iname FROM o),
    fd AS (SELECT doc_id, obj_id, 'metadata' AS category, 'Title metadata' AS title, 'informational' AS concern, 'supported-later' AS removal, own AS detail FROM k WHERE tag = 'title' AND own <> ''
      UNION ALL SELECT doc_id, obj_id, 'metadata', CASE WHEN iname IN ('Title','Author','Subject','Keywords','Creator','Producer') THEN iname || ' metadata' ELSE 'Custom Info metadata' END,
        CASE WHEN iname = 'Author' THEN 'review' ELSE 'informational' END, 'supported-later', content_ FROM k WHERE tag = 'meta' AND content_ <> ''
      UNION ALL SELECT doc_id, obj_id, 'active-content', 'JavaScript action', 'high', 'supported-later', '' FROM k WHERE tag = 'script'
      UNION ALL SELECT doc_id, obj_id, 'external-link', 'External URI action', 'review', 'supported-later', href_ FROM k WHERE uri
      UNION ALL SELECT doc_id, obj_id, 'annotation', 'Link annotation', 'review', 'supported-later', '' FROM k WHERE tag = 'a' AND NOT uri
      UNION ALL SELECT doc_id, obj_id, 'annotation', 'Text annotation', 'review', 'supported-later', own FROM k WHERE tag = '#comment'
      UNION ALL SELECT doc_id, obj_id, 'form', 'AcroForm present', 'informational', 'inspect-only', '' FROM k WHERE tag = 'form'
      UNION ALL SELECT doc_id, obj_id, 'form', 'Form field', 'review', 'inspect-only', name_ FROM k WHERE tag IN ('input', 'select', 'textarea')
      UNION ALL SELECT doc_id, obj_id, 'attachment', 'Embedded file reference', 'high', 'supported-later', src_ FROM k WHERE tag IN ('iframe', 'object', 'embed')
      UNION ALL SELECT doc_id, -1, 'image-metadata', 'Embedded images inventoried', 'informational', 'inspect-only', cast(count(*) AS varchar) FROM k WHERE tag = 'img' GROUP BY doc_id),
    docs AS (SELECT DISTINCT doc_id FROM k),
    grp AS (SELECT doc_id, CASE WHEN category = 'metadata' THEN 'metadata' WHEN category = 'attachment' THEN 'attachments' WHEN category = 'active-content' THEN 'activeContent'
       WHEN title = 'Text annotation' THEN 'comments' WHEN category = 'external-link' THEN 'externalLinks' WHEN category = 'form' THEN 'forms' ELSE 'layersOther' END AS g FROM fd),
    act AS (SELECT doc_id, obj_id, uri, lag(obj_id) OVER (PARTITION BY doc_id ORDER BY obj_id) AS prev FROM k WHERE uri OR tag = 'script'),
    seg AS (SELECT *, prev IS NULL OR prev % 3 = 0 AS first, sum(CASE WHEN prev IS NULL OR prev % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY obj_id) AS s FROM act),
    reach AS (SELECT *, coalesce(max(CASE WHEN uri THEN obj_id END) OVER (PARTITION BY doc_id, s) >= obj_id, false) AS u,
       coalesce(max(CASE WHEN NOT uri THEN obj_id END) OVER (PARTITION BY doc_id, s) >= obj_id, false) AS j FROM seg),
    gone AS (SELECT doc_id, obj_id FROM k WHERE (tag IN ('title', 'meta') AND doc_id % 3 = 0) OR (tag IN ('iframe', 'object', 'embed') AND doc_id % 6 = 0)
       OR (tag = 'script' AND doc_id % 4 <> 0) OR (uri AND doc_id % 2 = 0))"""
_W = f"WITH {ctes('fx_risky_pages')}, {_OBJ}"
_STEPS = """sel AS (SELECT doc_id, 'metadata' AS step FROM docs WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'attachments' FROM docs WHERE doc_id % 6 = 0
      UNION ALL SELECT doc_id, 'activeContent' FROM docs WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, 'externalLinks' FROM docs WHERE doc_id % 2 = 0),
    sec AS (SELECT doc_id, count(DISTINCT href_) AS n FROM k WHERE uri AND length(href_) >= 4 GROUP BY doc_id),
    st AS (SELECT s.doc_id, s.step, (SELECT count(*) FROM grp WHERE grp.doc_id = s.doc_id AND g = s.step) AS before, cast(0 AS bigint) AS after,
      CASE WHEN s.step = 'externalLinks' AND s.doc_id % 5 = 0 THEN coalesce(n, 0) ELSE 0 END AS residual FROM sel s LEFT JOIN sec USING (doc_id)),
    vr AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'could-not-verify' WHEN residual > 0 THEN 'removal-failed' ELSE 'verified-removed' END AS status FROM st)"""
_GROUPS = ", ".join(f"('{g}', {str(s).lower()})" for g, s in f.GROUPS)
_COVERAGE = ", ".join("('%s', '%s')" % (c, "partial" if c in f.PARTIAL else "inspection-only" if c in f.INSPECT_ONLY else "inspected") for c in f.CATEGORIES)
_MARKS = f"""{ctes('fx_marks')}, bad AS (SELECT DISTINCT m.doc_id, 'invalid-mark' AS reason FROM fx_marks m JOIN documents d USING (doc_id) WHERE end_ > length(text) OR end_ <= start
    UNION SELECT DISTINCT doc_id, 'unsupported-document' FROM fx_marks WHERE doc_id % 19 = 0)"""
_POLICY = f"""{ctes('fx_policy_docs', 'fx_policy_pages')}, pg AS (SELECT doc_id, count(*) AS pages, bool_and(abs(least(width, height) - CASE WHEN doc_id % 3 = 2 THEN 595.28 ELSE 612 END) <= 3
      AND abs(greatest(width, height) - CASE WHEN doc_id % 3 = 2 THEN 841.89 ELSE 792 END) <= 3) AS fits FROM fx_policy_pages GROUP BY doc_id),
    pd AS (SELECT d.*, pages, fits, CASE policy WHEN 'p0' THEN 0.002 * 1024 * 1024 WHEN 'p2' THEN 1024 * 1024 END AS lim, CASE policy WHEN 'p0' THEN 10 WHEN 'p2' THEN 1000 END AS mp FROM fx_policy_docs d JOIN pg USING (doc_id)),
    ck AS (SELECT doc_id, 0 AS o, 'file-size' AS key, CASE WHEN lim IS NULL THEN 'not-checked' WHEN bytes <= lim THEN 'pass' WHEN encrypted THEN 'fail' WHEN NOT signed THEN 'can-fix' ELSE 'needs-decision' END AS state FROM pd
      UNION ALL SELECT doc_id, 1, 'page-count', CASE WHEN encrypted OR mp IS NULL THEN 'not-checked' WHEN pages <= mp THEN 'pass' ELSE 'fail' END FROM pd
      UNION ALL SELECT doc_id, 2, 'page-size', CASE WHEN encrypted OR policy = 'p1' THEN 'not-checked' WHEN fits THEN 'pass' ELSE 'fail' END FROM pd
      UNION ALL SELECT doc_id, 3, 'encryption', CASE WHEN encrypted THEN 'fail' ELSE 'pass' END FROM pd
      UNION ALL SELECT doc_id, 4, 'active-actions', CASE WHEN encrypted OR policy = 'p1' OR active_actions IS NULL THEN 'not-checked' WHEN active_actions = 0 THEN 'pass' WHEN signed THEN 'needs-decision' ELSE 'can-fix' END FROM pd),
    lb AS (SELECT ck.*, CASE key {' '.join(f"WHEN '{k}' THEN '{l}'" for k, l in p.LABELS.items())} END AS label FROM ck)"""
_PATH = """CASE WHEN tag IN ('title', 'meta') THEN 'trailer/Info' WHEN tag = 'form' THEN 'trailer/Root' WHEN tag = 'script' THEN 'trailer/Root/Names/JavaScript'
    WHEN tag IN ('input', 'select', 'textarea') THEN 'trailer/Root/AcroForm/Fields/0' ELSE 'trailer/Root/Pages/' || tag END"""

ORACLES = {
    "k2_html_objects": f"""{_W} SELECT doc_id, obj_id, tag, {_PATH} AS path, CASE WHEN tag = 'title' THEN 'Title=' || own WHEN tag = 'meta' THEN CASE WHEN name_ = '' THEN 'Charset' ELSE iname END || '=' || content_
        WHEN tag = 'script' THEN 'JS=' || src_ || ';S=JavaScript' WHEN uri THEN 'S=URI;URI=' || href_ WHEN tag = 'a' THEN 'Dest=' || href_ || ';Subtype=Link;Type=Annot'
        WHEN tag = '#comment' THEN 'Contents=' || own || ';Subtype=Text;Type=Annot' WHEN tag = 'form' THEN 'AcroForm=1'
        WHEN tag IN ('input', 'select', 'textarea') THEN 'FT=' || type_ || ';T=' || name_ || ';V=' || value_ WHEN tag = 'img' THEN 'F=' || src_ || ';Subtype=Image'
        WHEN tag IN ('iframe', 'object', 'embed') THEN 'Type=Filespec;UF=' || src_ ELSE 'Tag=' || tag END AS attrs FROM k""",
    "f1_reachability": """SELECT 'r' || r_regionkey AS obj_id, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey = 7 THEN -1 ELSE 1 END FROM nation
        UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_nationkey = 7 THEN -1 ELSE 2 END FROM customer
        UNION ALL SELECT 'o' || o_orderkey, CASE WHEN c_nationkey = 7 OR c_custkey IS NULL THEN -1 ELSE 3 END FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
    "f2_classify_objects": f"{_W} SELECT * FROM fd",
    "f3_structure_counts": f"""{_W}, b AS (SELECT doc_id, count_if(tag IN ('iframe', 'object', 'embed')) AS file_specs, count_if(tag = 'script') AS dangerous_actions, count_if(uri) AS uri_actions,
          count_if(tag = '#comment') AS review_annotations, count_if(tag = 'a' AND NOT uri) AS preserved_annotations FROM k GROUP BY doc_id),
        r AS (SELECT doc_id, count_if(j) AS dangerous_entries, count_if(j AND NOT first) AS dangerous_next, count_if(u) AS uri_entries, count_if(u AND NOT first) AS uri_next FROM reach GROUP BY doc_id)
        SELECT doc_id, file_specs, 0::BIGINT AS ef_dictionaries, 0::BIGINT AS associated_files, 0::BIGINT AS file_annotations, dangerous_actions, uri_actions, review_annotations, 0::BIGINT AS popups,
          preserved_annotations, 0::BIGINT AS ambiguous_annotations, 0::BIGINT AS dangerous_open_actions, coalesce(dangerous_entries, 0) AS dangerous_entries, 0::BIGINT AS dangerous_additional, coalesce(dangerous_next, 0) AS dangerous_next,
          0::BIGINT AS uri_open_actions, coalesce(uri_entries, 0) AS uri_entries, 0::BIGINT AS uri_additional, coalesce(uri_next, 0) AS uri_next FROM b LEFT JOIN r USING (doc_id)""",
    "f4_covered_text": f"""WITH {ctes('fx_words', 'fx_covers')} SELECT w.doc_id, w.page, count(*) AS covered FROM fx_words w JOIN fx_covers c ON c.doc_id = w.doc_id AND c.page = w.page
        WHERE NOT hidden AND after_text AND fill = '#000000' AND x + width * 0.25 >= x0 AND x + width * 0.75 <= x1 AND y - height * 0.1 >= y0 AND y + height * 0.75 <= y1 GROUP BY ALL""",
    "f5_offpage_text": f"WITH {ctes('fx_words')} SELECT doc_id, page, count(*) AS items FROM fx_words WHERE x > 617 OR y > 797 GROUP BY ALL",
    "f6_hidden_text_class": f"""WITH {ctes('fx_words', 'fx_word_pages')}, h AS (SELECT doc_id, page, count(*) AS total, count_if(hidden AND x <= 617) AS hidden FROM fx_words GROUP BY ALL)
        SELECT doc_id, page, hidden, images, CASE WHEN images > 0 AND hidden >= 12 AND hidden >= total * 0.75 THEN 'search layer' WHEN images > 0 THEN 'uncertain' ELSE 'suspicious hidden text' END AS classification
        FROM h JOIN fx_word_pages USING (doc_id, page) WHERE hidden > 0""",
    "f7_group_findings": f"""{_W} SELECT d.doc_id, v.g AS "group", v.s AS supported, (SELECT count(*) FROM grp WHERE grp.doc_id = d.doc_id AND grp.g = v.g) AS n FROM docs d, (VALUES {_GROUPS}) v(g, s)""",
    "f8_coverage_matrix": f"SELECT page_id AS doc_id, c AS category, s AS state FROM pages, (VALUES {_COVERAGE}) v(c, s)",
    "f9_default_selection": f"""{_W} SELECT d.doc_id, exists(SELECT 1 FROM grp WHERE grp.doc_id = d.doc_id AND g = 'metadata') AS metadata, exists(SELECT 1 FROM grp WHERE grp.doc_id = d.doc_id AND g = 'attachments') AS attachments,
        exists(SELECT 1 FROM grp WHERE grp.doc_id = d.doc_id AND g = 'activeContent') AS "activeContent", false AS comments, false AS "externalLinks" FROM docs d""",
    "f10_remove_findings": f"{_W} SELECT doc_id, obj_id, {_PATH} AS path FROM k WHERE (doc_id, obj_id) NOT IN (SELECT (doc_id, obj_id) FROM gone)",
    "f10_kept_entries": f"{_W} SELECT doc_id, obj_id AS dst FROM act WHERE (doc_id, obj_id) NOT IN (SELECT (doc_id, obj_id) FROM gone)",
    "f10_removed_replies": "SELECT conv_id AS doc_id, turn AS obj_id FROM conversations WHERE conv_id % 4 = 0 AND turn >= 1",
    "f11_verify_removal": f"{_W}, {_STEPS} SELECT * FROM vr",
    "f12_combine_status": f"""{_W}, {_STEPS} SELECT doc_id, CASE max(CASE status WHEN 'removal-failed' THEN 2 WHEN 'could-not-verify' THEN 1 ELSE 0 END) WHEN 2 THEN 'removal-failed' WHEN 1 THEN 'could-not-verify' ELSE 'verified-removed' END AS status,
        cast(sum(before) AS bigint) AS before, cast(sum(after) AS bigint) AS after FROM vr GROUP BY doc_id""",
    "f13_redact": f"""WITH {_MARKS}, g AS (SELECT * FROM fx_marks WHERE doc_id NOT IN (SELECT doc_id FROM bad)),
        w AS (SELECT doc_id, start, end_, max(end_) OVER (PARTITION BY doc_id ORDER BY start, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g),
        v AS (SELECT *, sum(CASE WHEN reach >= start THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, end_ ROWS UNBOUNDED PRECEDING) AS island FROM w),
        c AS (SELECT doc_id, island, min(start) AS a, max(end_) AS b FROM v GROUP BY ALL),
        e AS (SELECT c.*, text, coalesce(lag(b) OVER (PARTITION BY c.doc_id ORDER BY island), 0) AS before FROM c JOIN documents USING (doc_id)),
        t AS (SELECT doc_id, string_agg(substr(text, before + 1, a - before) || repeat('█', b - a), '' ORDER BY island) || substr(any_value(text), max(b) + 1) AS red,
          list(substr(text, a + 1, b - a)) FILTER (b - a >= 4) AS secrets, cast(sum(b - a) AS bigint) AS masked, any_value(length(text)) AS n FROM e GROUP BY doc_id),
        u AS (SELECT *, coalesce(len(list_filter(secrets, lambda s: contains(red, s))) > 0, false) AS residue FROM t)
        SELECT doc_id, md5(red) AS text, masked, n - masked AS preserved, true AS gone, true AS unchanged, residue, CASE WHEN residue THEN 'failed' ELSE 'passed' END AS status FROM u""",
    "f13_mark_problems": f"WITH {_MARKS} SELECT * FROM bad",
    "f14_preflight": f"WITH {_POLICY} SELECT doc_id, key, label, state FROM lb",
    "f15_preflight_plan": f"""WITH {_POLICY}, x AS (SELECT doc_id, CASE state WHEN 'pass' THEN 'passed' WHEN 'can-fix' THEN 'can_fix' WHEN 'not-checked' THEN 'not_checked' ELSE 'needs_decision' END AS b,
          o + CASE WHEN state = 'needs-decision' THEN 10 ELSE 0 END AS o, label FROM lb
          UNION ALL SELECT doc_id, CASE WHEN active_actions IS NULL THEN 'not_checked' ELSE 'needs_decision' END, 99, 'Metadata and XMP' FROM fx_policy_docs WHERE active_actions IS NULL OR active_actions > 0)
        SELECT doc_id, {', '.join(f"coalesce(string_agg(label, '; ' ORDER BY o) FILTER (b = '{b}'), '') AS {b}" for b in ('passed', 'can_fix', 'needs_decision', 'not_checked'))} FROM x GROUP BY doc_id""",
    "f16_apply_approved": f"""WITH {ctes('fx_policy_docs')}, a AS (SELECT *, doc_id % 3 = 0 AS ra, doc_id % 2 = 0 AS op FROM fx_policy_docs),
        b AS (SELECT *, CASE WHEN NOT (ra OR op) THEN 'nothing-approved' WHEN signed THEN 'signed' WHEN signed IS NULL THEN 'signature-unknown' END AS ref, op AND candidate_bytes < bytes AS ad FROM a)
        SELECT doc_id, coalesce(ref, CASE WHEN ad OR ra THEN 'changed' ELSE 'no-savings' END) AS outcome, CASE WHEN ref IS NULL AND ra THEN coalesce(active_actions, 0) ELSE 0 END AS removed_actions,
          CASE WHEN ref IS NULL AND ad THEN candidate_bytes ELSE bytes END AS bytes, CASE WHEN ref IS NULL AND ad THEN greatest(0, bytes - candidate_bytes) ELSE 0 END AS saved, ref IS NULL AND ad AS adopted FROM b""",
}
