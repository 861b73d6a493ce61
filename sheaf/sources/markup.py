"""Built-in extractor: web pages to the object-graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sheaf.functions.text import js_trim

_TAG = r"(?is)<!--.*?-->|<title\b[^>]*>[^<]*|<[a-z][^>]*>"


def html_objects(pages: DataFrame, doc: str = "page_id", html: str = "html") -> DataFrame:
    """(doc_id, obj_id, tag, path, attrs MAP): one row per tag or comment in document order.

    Markup is named with the object vocabulary of the findings operators: scripts are JavaScript
    actions, outside links URI actions, comments review notes, title and meta the Info entries."""
    body = F.regexp_replace(F.col(html), r"(?is)(<script\b[^>]*>).*?</script>", "$1")
    d = pages.select(
        F.col(doc).alias("doc_id"), F.posexplode(F.regexp_extract_all(body, F.lit(_TAG), 0)).alias("obj_id", "raw")
    )
    comment = F.startswith("raw", F.lit("<!--"))
    tag = F.when(comment, "#comment").otherwise(F.lower(F.regexp_extract("raw", r"^<([A-Za-z][A-Za-z0-9]*)", 1)))
    attribute = lambda name: F.regexp_extract(
        F.when(comment, "").otherwise(F.col("raw")), rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']""", 1)
    d = d.withColumns({
        "tag": tag, "href": attribute("href"), "src": attribute("src"), "name": attribute("name"),
        "content": attribute("content"), "value": attribute("value"), "type": attribute("type"),
        "own": F.when(comment, js_trim(F.regexp_replace("raw", r"^<!--|-->\z", ""))).otherwise(
            js_trim(F.regexp_replace("raw", "^<[^>]*>", ""))),
    })
    t = F.col("tag")
    entries = lambda *pairs: F.create_map(*[F.lit(x) if isinstance(x, str) else x for kv in pairs for x in kv])
    outside = (t == "a") & F.col("href").rlike("(?i)^https?:")
    info_key = F.when(F.col("name") == "", "Charset").otherwise(F.initcap("name"))
    attrs = (
        F.when(t == "title", entries(("Title", F.col("own"))))
        .when(t == "meta", F.create_map(info_key, F.col("content")))
        .when(t == "script", entries(("S", "JavaScript"), ("JS", F.col("src"))))
        .when(outside, entries(("S", "URI"), ("URI", F.col("href"))))
        .when(t == "a", entries(("Type", "Annot"), ("Subtype", "Link"), ("Dest", F.col("href"))))
        .when(t == "#comment", entries(("Type", "Annot"), ("Subtype", "Text"), ("Contents", F.col("own"))))
        .when(t == "form", entries(("AcroForm", "1")))
        .when(t.isin("input", "select", "textarea"), entries(("T", F.col("name")), ("FT", F.col("type")), ("V", F.col("value"))))
        .when(t == "img", entries(("Subtype", "Image"), ("F", F.col("src"))))
        .when(t.isin("iframe", "object", "embed"), entries(("Type", "Filespec"), ("UF", F.col("src"))))
        .otherwise(entries(("Tag", t)))
    )
    path = (
        F.when(t.isin("title", "meta"), "trailer/Info").when(t == "form", "trailer/Root")
        .when(t == "script", "trailer/Root/Names/JavaScript").when(t.isin("input", "select", "textarea"), "trailer/Root/AcroForm/Fields/0")
        .otherwise(F.concat(F.lit("trailer/Root/Pages/"), t))
    )
    return d.select("doc_id", F.col("obj_id").cast("bigint").alias("obj_id"), "tag", path.alias("path"), attrs.alias("attrs"))


def document_edges(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, roots): every object hangs on its document root, node -1."""
    edges = objects.select("doc_id", F.lit(-1).cast("bigint").alias("src"), F.col("obj_id").alias("dst"), F.lit("Kids").alias("key"))
    roots = objects.select("doc_id", F.lit(-1).cast("bigint").alias("node")).distinct()
    return edges, roots
