"""Catalog and web tables: search, related items, site inventory, URL batches, metadata audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sheaf.functions.text import WS, is_blank, js_trim
from sheaf.functions.urls import canonical
from sheaf.session import stage

URLS_PER_BATCH = 10_000


GRAM = 3


def _grams(text: Column, n: int) -> Column:
    many = F.length(text) - n + 1
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), many))
    return F.when(many > 0, F.transform(at, lambda s: F.substr(text, s, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def search_catalog(items: DataFrame, categories: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """First ``k`` available items, in catalog order, whose text contains the query.

    ``items(item_no, href, name, description, category, keywords ARRAY, available)``,
    ``categories(category, category_name)``, ``queries(query_no, query)``. Postings hold the item numbers of every gram
    of three characters that a query has. A query asks for the items of its rarest gram, and only those texts are read
    again; a query of three characters or fewer is its own gram and needs no look at texts."""
    asked = queries.withColumn("q", F.lower(js_trim("query"))).filter("q <> ''").select("query_no", "q")
    # The same words are searched once however often they are asked.
    q = asked.select("q").distinct()
    short = F.length("q") <= GRAM
    wanted = q.select("q", short.alias("short"), F.explode(F.when(short, F.array("q")).otherwise(F.array_distinct(_grams(F.col("q"), GRAM)))).alias("gram"))
    i = items.filter("available AND href IS NOT NULL").join(categories, "category", "left")
    text = F.lower(F.concat_ws(" ", "name", "description", "category", F.coalesce("category_name", F.lit("")), F.array_join("keywords", " ")))
    i = stage(i.select("item_no", "href", text.alias("t")))
    grams = F.array_distinct(F.concat(*[_grams(F.col("t"), n) for n in range(1, GRAM + 1)]))
    postings = stage(i.select("item_no", F.explode(grams).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi"))
    counts = postings.groupBy("gram").agg(F.count("*").alias("of"))
    rarest = wanted.join(counts, "gram", "left").groupBy("q", "short").agg(F.min(F.struct(F.coalesce("of", F.lit(0)).alias("of"), "gram")).alias("g"))
    rarest = rarest.filter("g.of > 0").select("q", "short", "g.gram")
    hits = postings.join(rarest, "gram")
    tested = hits.filter("NOT short").join(i.select("item_no", "t"), "item_no").filter(F.contains("t", "q"))
    hits = hits.filter("short").select("q", "item_no").unionByName(tested.select("q", "item_no"))
    order = Window.partitionBy("q").orderBy("item_no")
    top = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return asked.join(top, "q").join(i.select("item_no", "href"), "item_no").select("query_no", "rank", "item_no", "href")


def category_members(items: DataFrame, category: Column) -> DataFrame:
    return items.filter(F.col("category") == category)


def related_items(items: DataFrame) -> DataFrame:
    """(href, position, related): listed order, unavailable and unknown targets dropped."""
    wanted = items.select("href", F.posexplode("related").alias("position", "target"))
    known = items.filter("available AND href IS NOT NULL").select(F.col("href").alias("target"), F.col("item_no").alias("related"))
    return wanted.join(known, "target").select("href", "position", "related")


def expected_urls(items: DataFrame, categories: DataFrame, origin: str, routes: list[str]) -> DataFrame:
    """(url, change, priority) of fixed pages, available items and categories."""
    spark = items.sparkSession
    fixed = spark.createDataFrame([(r,) for r in routes], "route string")
    pages = fixed.unionByName(items.filter("available AND href IS NOT NULL").select(F.col("href").alias("route")))
    a = pages.select(
        F.concat(F.lit(origin), "route").alias("url"), F.lit("monthly").alias("change"),
        F.when(F.col("route") == "", 1.0).otherwise(0.4).alias("priority"))
    b = categories.select(
        F.concat(F.lit(origin + "/categories/"), "category").alias("url"), F.lit("weekly").alias("change"), F.lit(0.8).alias("priority"))
    return a.unionByName(b)


def canonical_urls(df: DataFrame, url: str, origin: str) -> tuple[DataFrame, DataFrame]:
    """(distinct canonical URLs with batch numbers, refused input URLs).

    Numbers follow the md5 order: 4096 prefix groups are counted, their offsets summed, and rows are
    numbered inside a group, so no single task orders all URLs."""
    d = df.select(F.col(url).alias("given"), canonical(url, origin).alias("url"))
    refused = d.filter("url IS NULL").select("given")
    u = d.filter("url IS NOT NULL").select("url").distinct().withColumn("h", F.md5("url")).withColumn("p", F.left("h", F.lit(3)))
    sizes = u.groupBy("p").agg(F.count("*").alias("n"))
    # At most 4096 rows reach this window.
    prior = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("p", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("offset"))
    n = F.row_number().over(Window.partitionBy("p").orderBy("h", "url"))
    numbered = u.withColumn("n", n).join(offsets, "p")
    batch = F.floor((F.col("n") + F.col("offset") - 1) / URLS_PER_BATCH)
    return numbered.select("url", batch.alias("batch")), refused


def sitemap_urls(df: DataFrame, xml: str) -> DataFrame:
    return df.select(F.explode(F.regexp_extract_all(F.col(xml), F.lit("<loc>([^<]+)</loc>"), 1)).alias("url"))


def _attribute(tags: Column, key: str) -> Column:
    tag = F.try_element_at(F.filter(tags, lambda t: F.contains(t, F.lit(f'"{key}"'))), F.lit(1))
    return F.regexp_extract(F.coalesce(tag, F.lit("")), r'(?:content|href)="([^"]*)"', 1)


def _decode(text: Column) -> Column:
    for entity, char in (("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return js_trim(F.regexp_replace(text, WS + "+", " "))


def page_metadata(pages: DataFrame) -> DataFrame:
    """``pages(page_id, page_url, category, related, html)`` with the audited fields of the markup."""
    tags = F.regexp_extract_all("html", F.lit(r"<(?:meta|link)\b[^>]*>"), 0)
    ld = F.regexp_extract_all("html", F.lit(r'(?s)<script type="application/ld\+json">(.*?)</script>'), 1)
    schema = "struct<`@type`:string,url:string,mainEntity:array<struct<name:string,acceptedAnswer:struct<text:string>>>>"
    parsed = F.transform(ld, lambda x: F.from_json(x, schema))
    visible = _decode(F.regexp_replace(F.regexp_replace("html", r"(?s)<script\b[^>]*>.*?</script>", ""), "<[^>]*>", " "))
    return pages.select(
        "page_id", "page_url", "category", "related",
        F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
        _attribute(tags, "description").alias("description"), _attribute(tags, "canonical").alias("canonical"),
        _attribute(tags, "og:url").alias("social_url"), _attribute(tags, "robots").alias("robots"),
        parsed.alias("schemas"), visible.alias("visible"),
    )


def audit_page_metadata(pages: DataFrame, categories: DataFrame) -> DataFrame:
    """(page_id, check): one row per violation."""
    m = page_metadata(pages)
    apps = F.filter("schemas", lambda s: s["@type"] == "SoftwareApplication")
    questions = F.flatten(F.transform(
        F.filter("schemas", lambda s: (s["@type"] == "FAQPage") & s["mainEntity"].isNotNull()), lambda s: s["mainEntity"]))
    hidden = lambda q: ~F.contains("visible", _decode(q["name"])) | ~F.contains("visible", _decode(q["acceptedAnswer"]["text"]))
    when = lambda test, name: F.when(test, F.lit(name))
    own = F.col("page_url")
    checks = F.array(
        when(is_blank("title"), "missing-title"), when(is_blank("description"), "missing-description"),
        when(F.col("canonical") == "", "missing-canonical"),
        when((F.col("canonical") != "") & (F.col("canonical") != own), "wrong-canonical"),
        when(F.col("social_url") != own, "wrong-social-url"),
        when(F.col("robots").rlike(r"(?i)\bnoindex\b"), "noindex"),
        when(F.size(apps) != 1, "application-schema-count"),
        when(F.exists(apps, lambda s: ~s["url"].eqNullSafe(own)), "application-schema-url"),
        when(F.exists(questions, hidden), "hidden-faq"),
        when(F.concat(F.lit(""), "related") == F.regexp_replace("page_url", "^[a-z]+://[^/]+", ""), "self-related"),
    )
    slim = m.withColumn("checks", F.filter(checks, lambda c: c.isNotNull())).select(
        "page_id", "page_url", "category", "related", "title", "description", "checks")
    own_rows = slim.select("page_id", F.explode("checks").alias("check"))

    def repeated(field: str, check: str) -> DataFrame:
        rows = slim.filter(~is_blank(field)).select("page_id", F.xxhash64(field).alias("h"), field)
        again = rows.groupBy("h", field).agg(F.count("*").alias("n")).filter("n > 1").select("h", field)
        return rows.join(again, ["h", field], "left_semi").select("page_id", F.lit(check).alias("check"))

    paths = slim.select(F.regexp_replace("page_url", "^[a-z]+://[^/]+", "").alias("related"))
    dangling = slim.join(paths.distinct(), "related", "left_anti").select("page_id", F.lit("dangling-related").alias("check"))
    unknown = slim.join(categories, "category", "left_anti").select("page_id", F.lit("unknown-category").alias("check"))
    out = own_rows.unionByName(repeated("title", "duplicate-title")).unionByName(repeated("description", "duplicate-description"))
    return out.unionByName(dangling).unionByName(unknown)


def compare_sets(expected: DataFrame, actual: DataFrame, column: str) -> DataFrame:
    """Differences of two sets: (value, verdict missing / extra / duplicate); empty when equal."""
    e = expected.groupBy(column).agg(F.count("*").alias("e"))
    a = actual.groupBy(column).agg(F.count("*").alias("a"))
    d = e.join(a, column, "full_outer")
    verdict = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when((F.col("a") > 1) | (F.col("e") > 1), "duplicate")
    return d.select(column, verdict.alias("verdict")).filter("verdict IS NOT NULL")
