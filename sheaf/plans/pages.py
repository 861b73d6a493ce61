"""Page-manifest, catalog and web queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.fixtures import ctes, load
from sheaf.operators import manifest as m, web as w


def _man(s, sf):
    return load(s, sf, "fx_manifest").drop("bytes")


def _picked(s, sf, n=3):
    return _man(s, sf).filter((F.col("ordinal") + F.col("job_id")) % n == 0).select("job_id", "page_id")


def _selection(s, sf):
    d = m.parse_selection(load(s, sf, "fx_expressions"), "expr", "page_count")
    return d.select("job_id", "expr", F.coalesce("error", F.lit("")).alias("error"),
                    F.coalesce(F.array_join(F.col("pages").cast("array<string>"), ","), F.lit("")).alias("pages"),
                    F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("label", F.lit("")).alias("label"))


def _ranges(s, sf):
    d = m.parse_ranges(load(s, sf, "fx_expressions"), "expr", "page_count")
    return d.select("job_id", F.coalesce("error", F.lit("")).alias("error"), F.coalesce(F.size("groups"), F.lit(-1)).alias("n"),
                    F.coalesce(F.array_join(F.transform("groups", lambda g: g["label"]), ";"), F.lit("")).alias("labels"))


def _groups(s, sf):
    d = m.parse_ranges(load(s, sf, "fx_expressions"), "expr", "page_count")
    return d.select("job_id", F.inline("groups"))


def _inputs(s, sf):
    c = load(s, sf, "fx_manifest")
    return c.select((F.col("source_id") % 20).alias("job_id"), F.col("source_id").alias("source_no"), "source_id",
                    "page_index", "bytes")


def _edit(s, sf):
    man, sel = _man(s, sf), _picked(s, sf)
    d = m.delete_pages(man, _picked(s, sf, 5))
    d = m.rotate_pages(d, sel, clockwise=False)
    d = m.duplicate_pages(d, sel)
    return d.select("job_id", F.col("ordinal").cast("bigint").alias("ordinal"), "page_id", "rotation", F.col("copy").cast("int").alias("copy"))


def _insert_move(s, sf):
    man = _man(s, sf)
    moves = man.filter("ordinal = 0").select("job_id", "page_id", F.lit(2).alias("target"))
    moved = m.move_pages(man, moves)
    added = man.filter("ordinal < 2").withColumn("page_id", -F.col("page_id") - 1)
    after = man.filter((F.col("ordinal") == 1) & (F.col("job_id") % 2 == 0)).select("job_id", "page_id")
    return m.insert_pages(moved, added, after, "after").select("job_id", F.col("ordinal").cast("bigint").alias("ordinal"), "page_id")


def _rotation(s, sf):
    pending = _man(s, sf).select("job_id", "page_index", F.explode(F.array(F.lit(90), (F.col("page_index") % 3 * 90))).alias("adjust"))
    d, _ = m.effective_rotation(_man(s, sf), pending.filter("page_index % 2 = 0"))
    return d.select("job_id", "page_index", "rotation", "effective")


def _rotation_counts(s, sf):
    pending = _man(s, sf).select("job_id", "page_index", F.explode(F.array(F.lit(90), (F.col("page_index") % 4 * 90))).alias("adjust"))
    return m.effective_rotation(_man(s, sf), pending)[1]


def _guard(s, sf):
    p = load(s, sf, "pages").select(
        (F.col("page_id") % 10).alias("job_id"), (F.length("html") % 300 + F.col("page_id") % 7 * 20).alias("width"),
        F.lit(400).alias("height"), F.octet_length("html").cast("bigint").alias("bytes"))
    return m.workload_guard(p, max_items=1000, max_bytes=10**9, max_side=410, max_pixels=2 * 10**6)


def _items(s, sf):
    c = load(s, sf, "fx_catalog")
    return c.withColumn("keywords", F.array(F.concat("category", F.lit(" kit")))).withColumn("related", F.array("rel1", "rel2", "rel3"))


def _categories(s, sf):
    return load(s, sf, "fx_catalog").select("category").distinct().withColumn(
        "category_name", F.concat(F.lit("Line "), F.regexp_extract("category", r"(\d+)", 1)))


def _search(s, sf):
    q = load(s, sf, "part").select(F.col("p_partkey").alias("query_no"), F.when(F.col("p_partkey") % 3 == 0, F.initcap(F.regexp_extract("p_name", r"(\w+)$", 1)))
                                   .when(F.col("p_partkey") % 3 == 1, F.left("p_type", F.lit(2))).otherwise(F.concat(F.lit("line "), F.col("p_size").cast("string"))).alias("query"))
    return w.search_catalog(_items(s, sf), _categories(s, sf), q).select("query_no", "rank", "item_no")


def _urls(s, sf):
    p = load(s, sf, "pages")
    given = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/p/"), F.col("page_id") % 50, F.lit("/#top"))).when(
        F.col("page_id") % 4 == 1, F.concat(F.lit("HTTPS://Site.example:443/P/"), "page_id")).when(
        F.col("page_id") % 4 == 2, F.lit("https://site.example/?q=1")).otherwise(F.col("url"))
    return w.canonical_urls(p.select(given.alias("given")), "given", "https://site.example")


def _expected(s, sf):
    return w.expected_urls(_items(s, sf), _categories(s, sf), "https://site.example", ["", "/privacy", "/terms", "/contact"])


def _audit(s, sf):
    pages = load(s, sf, "fx_site_pages")
    cats = pages.select("category").distinct().filter("category <> 'c5'")
    return w.audit_page_metadata(pages, cats)


def _sets(s, sf):
    actual = load(s, sf, "fx_catalog").filter("available OR item_no % 7 = 0").select(F.concat(F.lit("https://site.example"), "href").alias("url"))
    return w.compare_sets(_expected(s, sf).select("url"), actual.unionByName(actual.filter("url LIKE '%11'")), "url")


QUERIES = {
    "p1_parse_selection": _selection,
    "p2_parse_ranges": _ranges,
    "p2_every_page_groups": lambda s, sf: m.every_page_groups(load(s, sf, "fx_expressions"), "page_count").select(
        "job_id", F.inline("groups")).select("job_id", "group_no", "start", "end", "label"),
    "p3_compact_pages": lambda s, sf: m.compact_pages(load(s, sf, "events"), "user_id", "event_id"),
    "p4_concat_manifests": lambda s, sf: m.concat_manifests(_inputs(s, sf))[0],
    "p4_concat_guard": lambda s, sf: m.concat_manifests(_inputs(s, sf))[1],
    "p5_split_manifest": lambda s, sf: m.split_totals(m.split_manifest(_man(s, sf), _groups(s, sf))),
    "p6_edit_manifest": _edit,
    "p6_insert_and_move": _insert_move,
    "p7_effective_rotation": _rotation,
    "p7_changed_rotations": _rotation_counts,
    "p8_number_pages": lambda s, sf: m.number_pages(_man(s, sf), _picked(s, sf), 5, "page-number-of-total", "[", "]").select("job_id", "ordinal", "label"),
    "p9_workload_guard": _guard,
    "w1_search_catalog": _search,
    "w2_related_items": lambda s, sf: w.related_items(_items(s, sf)),
    "w3_expected_urls": _expected,
    "w4_canonical_urls": lambda s, sf: _urls(s, sf)[0],
    "w4_refused_urls": lambda s, sf: _urls(s, sf)[1],
    "w5_audit_page_metadata": _audit,
    "w6_compare_sets": _sets,
    "s7_read_sitemap": lambda s, sf: w.sitemap_urls(load(s, sf, "pages").select(F.concat(
        F.lit("<urlset><url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url><url><loc>/p/"), F.col("page_id").cast("string"), F.lit("</loc></url></urlset>")).alias("xml")), "xml"),
}

_E = ctes("fx_expressions")
_TOK = rf"""{_E}, tok AS (SELECT job_id, page_count, expr, i, trim(t) AS t FROM (SELECT *, unnest(string_split(trim(expr), ',')) AS t,
      generate_subscripts(string_split(trim(expr), ','), 1) AS i FROM fx_expressions)),
    rng AS (SELECT *, regexp_full_match(t, '[0-9]+(\s*-\s*[0-9]+)?') AS ok, least(coalesce(try_cast(trim(split_part(t, '-', 1)) AS bigint), 9007199254740992),
        coalesce(try_cast(trim(CASE WHEN t LIKE '%-%' THEN split_part(t, '-', 2) ELSE t END) AS bigint), 9007199254740992)) AS s,
      greatest(coalesce(try_cast(trim(split_part(t, '-', 1)) AS bigint), 9007199254740992), coalesce(try_cast(trim(CASE WHEN t LIKE '%-%' THEN split_part(t, '-', 2) ELSE t END) AS bigint), 9007199254740992)) AS e FROM tok),
    err AS (SELECT *, CASE WHEN NOT ok OR s < 1 THEN 'invalid-page-selection' WHEN e > page_count THEN 'page-out-of-range'
        WHEN false THEN '' END AS er, exists(SELECT 1 FROM rng b WHERE b.job_id = rng.job_id AND b.i < rng.i AND b.s <= rng.e AND rng.s <= b.e) AS lap FROM rng),
    job AS (SELECT job_id, any_value(expr) AS expr, coalesce(CASE WHEN bool_or(t = '') THEN 'invalid-page-selection' END, min_by(er, i) FILTER (er IS NOT NULL), '') AS error,
        coalesce(CASE WHEN bool_or(t = '') THEN 'invalid-page-selection' END, min_by(coalesce(er, 'overlapping-ranges'), i) FILTER (er IS NOT NULL OR lap), '') AS error2 FROM err GROUP BY job_id)"""
_LABEL = "CASE WHEN a = b THEN cast(a AS varchar) ELSE a || '-' || b END"
_M = ctes("fx_manifest")
_CAT = ctes("fx_catalog")
_SITE = ctes("fx_site_pages")
_CANON = """u AS (SELECT DISTINCT CASE page_id % 4 WHEN 0 THEN 'https://site.example/p/' || page_id % 50 WHEN 1 THEN 'https://site.example/P/' || page_id ELSE 'https://site.example/?q=1' END AS url
    FROM pages WHERE page_id % 4 <> 3)"""
_EXPECTED = """e AS (SELECT 'https://site.example' || r AS url, 'monthly' AS change, CASE WHEN r = '' THEN 1.0 ELSE 0.4 END AS priority FROM
      (SELECT unnest(['', '/privacy', '/terms', '/contact']) AS r UNION ALL SELECT href FROM fx_catalog WHERE available)
    UNION ALL SELECT DISTINCT 'https://site.example/categories/' || category, 'weekly', 0.8 FROM fx_catalog)"""

ORACLES = {
    "p1_parse_selection": f"""WITH {_TOK}, pg AS (SELECT DISTINCT job_id, unnest(generate_series(s, e)) AS p FROM err JOIN job USING (job_id) WHERE error = ''),
        isl AS (SELECT *, p - row_number() OVER (PARTITION BY job_id ORDER BY p) AS g FROM pg), runs AS (SELECT job_id, min(p) AS a, max(p) AS b FROM isl GROUP BY job_id, g)
        SELECT job_id, expr, error, coalesce((SELECT string_agg(cast(p AS varchar), ',' ORDER BY p) FROM pg WHERE pg.job_id = job.job_id), '') AS pages,
          cast((SELECT count(*) FROM pg WHERE pg.job_id = job.job_id) AS int) AS n_pages,
          coalesce((SELECT string_agg({_LABEL}, '-' ORDER BY a) FROM runs WHERE runs.job_id = job.job_id), '') AS label FROM job""",
    "p2_parse_ranges": f"""WITH {_TOK} SELECT job_id, error2 AS error, cast(CASE WHEN error2 = '' THEN (SELECT count(*) FROM err WHERE err.job_id = job.job_id) ELSE -1 END AS int) AS n,
        CASE WHEN error2 = '' THEN (SELECT string_agg({_LABEL}, ';' ORDER BY i) FROM (SELECT s AS a, e AS b, i, job_id FROM err) x WHERE x.job_id = job.job_id) ELSE '' END AS labels FROM job""",
    "p2_every_page_groups": f"""WITH {_E} SELECT job_id, cast(p AS int) AS group_no, p AS start, p AS "end", cast(p AS varchar) AS label FROM (SELECT job_id, unnest(generate_series(1, page_count)) AS p FROM fx_expressions)""",
    "p3_compact_pages": f"""WITH i AS (SELECT DISTINCT user_id, event_id FROM events), g AS (SELECT *, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM i),
        r AS (SELECT user_id, min(event_id) AS a, max(event_id) AS b FROM g GROUP BY user_id, g) SELECT user_id, a AS start, b AS "end", {_LABEL} AS label FROM r""",
    "p4_concat_manifests": f"""WITH {_M} SELECT source_id % 20 AS job_id, row_number() OVER (PARTITION BY source_id % 20 ORDER BY source_id, page_index) - 1 AS ordinal, source_id AS source_no, source_id, page_index FROM fx_manifest""",
    "p4_concat_guard": f"""WITH {_M} SELECT source_id % 20 AS job_id, count(DISTINCT source_id) AS sources, count(*) AS pages, cast(sum(bytes) AS bigint) AS bytes,
        CASE WHEN count(DISTINCT source_id) < 2 THEN 'not-enough-files' ELSE 'ok' END AS status FROM fx_manifest GROUP BY 1""",
    "p5_split_manifest": f"""WITH {_TOK}, {_M} SELECT g.job_id, cast(i AS int) AS group_no, 'document-pages-' || CASE WHEN s = e THEN cast(s AS varchar) ELSE s || '-' || e END || '.pdf' AS output, count(*) AS page_count,
        cast(min(page_index) + 1 AS bigint) AS first_page, cast(max(page_index) + 1 AS bigint) AS last_page FROM err g JOIN job USING (job_id) JOIN fx_manifest m ON m.job_id = g.job_id AND m.page_index + 1 BETWEEN s AND e
        WHERE error2 = '' GROUP BY g.job_id, i, s, e""",
    "p6_edit_manifest": f"""WITH {_M}, k AS (SELECT *, (ordinal + job_id) % 3 = 0 AS sel FROM fx_manifest WHERE (ordinal + job_id) % 5 <> 0),
        x AS (SELECT *, unnest(generate_series(0, CASE WHEN sel THEN 1 ELSE 0 END)) AS copy FROM k)
        SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ordinal, copy) - 1 AS ordinal, page_id, cast(CASE WHEN sel THEN (rotation + 270) % 360 ELSE rotation END AS int) AS rotation, cast(copy AS int) AS copy FROM x""",
    "p6_insert_and_move": f"""WITH {_M}, n AS (SELECT job_id, count(*) AS n FROM fx_manifest GROUP BY job_id),
        mv AS (SELECT job_id, page_id, n, CASE WHEN n <= 2 THEN ordinal * 1.0 WHEN ordinal = 0 THEN 2.5 ELSE ordinal * 1.0 END AS o FROM fx_manifest JOIN n USING (job_id)),
        al AS (SELECT job_id, page_id, o, 0 AS k FROM mv UNION ALL
          SELECT f.job_id, -page_id - 1, CASE WHEN f.job_id % 2 = 0 AND n >= 2 THEN 1 ELSE 1e9 END, 1 + ordinal FROM fx_manifest f JOIN n USING (job_id) WHERE ordinal < 2)
        SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY o, k) - 1 AS ordinal, page_id FROM al""",
    "p7_effective_rotation": f"""WITH {_M} SELECT job_id, page_index, rotation, cast((rotation + CASE WHEN page_index % 2 = 0 THEN 90 + page_index % 3 * 90 ELSE 0 END) % 360 AS int) AS effective FROM fx_manifest""",
    "p7_changed_rotations": f"""WITH {_M} SELECT job_id, count_if((90 + page_index % 4 * 90) % 360 <> 0) AS changed FROM fx_manifest GROUP BY job_id""",
    "p8_number_pages": f"""WITH {_M} SELECT job_id, ordinal, '[Page ' || (4 + row_number() OVER (PARTITION BY job_id ORDER BY ordinal)) || ' of ' || count(*) OVER (PARTITION BY job_id) || ']' AS label
        FROM fx_manifest WHERE (ordinal + job_id) % 3 = 0""",
    "p9_workload_guard": """WITH i AS (SELECT page_id % 10 AS job_id, length(html) % 300 + page_id % 7 * 20 AS w, strlen(html) AS b FROM pages),
        j AS (SELECT job_id, count(*) AS items, cast(sum(b) AS bigint) AS bytes, cast(sum(w * 400) AS bigint) AS pixels, greatest(max(w), 400) AS side FROM i GROUP BY job_id)
        SELECT job_id, items, bytes, pixels, CASE WHEN items > 1000 THEN 'too-many-items' WHEN bytes > 1000000000 THEN 'total-too-large' WHEN side > 410 THEN 'dimensions-too-large' WHEN pixels > 2000000 THEN 'workload-too-large' ELSE 'ok' END AS status FROM j""",
    "w1_search_catalog": rf"""WITH {_CAT}, q AS (SELECT p_partkey AS query_no, lower(CASE p_partkey % 3 WHEN 0 THEN regexp_extract(p_name, '(\w+)$', 1) WHEN 1 THEN left(p_type, 2) ELSE 'line ' || p_size END) AS q FROM part),
        i AS (SELECT item_no, lower(concat_ws(' ', name, description, category, 'Line ' || regexp_extract(category, '([0-9]+)', 1), category || ' kit')) AS t FROM fx_catalog WHERE available),
        d AS (SELECT DISTINCT q FROM q), h AS (SELECT q, item_no, row_number() OVER (PARTITION BY q ORDER BY item_no) AS rank FROM d JOIN i ON contains(t, q))
        SELECT query_no, cast(rank AS int) AS rank, item_no FROM q JOIN h USING (q) WHERE rank <= 8""",
    "w2_related_items": f"""WITH {_CAT}, r AS (SELECT href, unnest([rel1, rel2, rel3]) AS t, unnest([0, 1, 2]) AS position FROM fx_catalog)
        SELECT r.href, position, c.item_no AS related FROM r JOIN fx_catalog c ON c.href = t AND c.available""",
    "w3_expected_urls": f"WITH {_CAT}, {_EXPECTED} SELECT url, change, cast(priority AS double) AS priority FROM e",
    "w4_canonical_urls": f"WITH {_CANON} SELECT url, (row_number() OVER (ORDER BY md5(url)) - 1) // 10000 AS batch FROM u",
    "w4_refused_urls": "SELECT url AS given FROM pages WHERE page_id % 4 = 3",
    "w5_audit_page_metadata": f"""WITH {_SITE}, m AS (SELECT page_id, page_url, category, related, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title,
          CASE WHEN page_id % 5 = 0 THEN '' ELSE 'About ' || (page_id - page_id % 3) END AS d FROM fx_site_pages)
        SELECT page_id, 'missing-title' AS "check" FROM m WHERE trim(title) = '' UNION ALL SELECT page_id, 'missing-description' FROM m WHERE d = ''
        UNION ALL SELECT page_id, 'wrong-canonical' FROM m WHERE page_id % 7 = 0 UNION ALL SELECT page_id, 'wrong-social-url' FROM m WHERE page_id % 8 = 0
        UNION ALL SELECT page_id, 'noindex' FROM m WHERE page_id % 9 = 0 UNION ALL SELECT page_id, 'application-schema-count' FROM m WHERE page_id % 10 = 0
        UNION ALL SELECT page_id, 'hidden-faq' FROM m WHERE page_id % 8 = 0
        UNION ALL SELECT page_id, 'self-related' FROM m WHERE related = '/p/' || page_id
        UNION ALL SELECT page_id, 'duplicate-title' FROM (SELECT *, count(*) OVER (PARTITION BY title) AS n FROM m WHERE trim(title) <> '') WHERE n > 1
        UNION ALL SELECT page_id, 'duplicate-description' FROM (SELECT *, count(*) OVER (PARTITION BY d) AS n FROM m WHERE d <> '') WHERE n > 1
        UNION ALL SELECT page_id, 'dangling-related' FROM m WHERE related NOT IN (SELECT '/p/' || page_id FROM pages)
        UNION ALL SELECT page_id, 'unknown-category' FROM m WHERE category = 'c5'""",
    "w6_compare_sets": f"""WITH {_CAT}, {_EXPECTED}, a AS (SELECT 'https://site.example' || href AS url, CASE WHEN href LIKE '%11' THEN 2 ELSE 1 END AS n FROM fx_catalog WHERE available OR item_no % 7 = 0)
        SELECT * FROM (SELECT coalesce(e.url, a.url) AS url, CASE WHEN a.url IS NULL THEN 'missing' WHEN e.url IS NULL THEN 'extra' WHEN n > 1 THEN 'duplicate' END AS verdict FROM e FULL JOIN a ON a.url = e.url) WHERE verdict IS NOT NULL""",
    "s7_read_sitemap": """SELECT replace(url, '&', '&amp;') AS url FROM pages UNION ALL SELECT '/p/' || page_id FROM pages""",
}
