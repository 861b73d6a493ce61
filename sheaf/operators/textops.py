"""Text statistics, keywords, case styles and cleaning over tables of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sheaf.functions.text import NOT_WS, WORD, WS, col, is_blank, js_round, js_trim, unify_newlines

# Common English words that never count as keywords.
STOP_WORDS = """
a about above after again against all am an and any are aren't as at be because been before being
below between both but by can't cannot could couldn't did didn't do does doesn't doing don't down during
each few for from further had hadn't has hasn't have haven't having he he'd he'll he's her here
here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's
its itself let's me more most mustn't my myself no nor not of off on once only or other ought
our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than
that that's the their theirs them themselves then there there's these they they'd they'll they're they've this
those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's
when when's where where's which while who who's whom why why's with won't would wouldn't you you'd you'll
you're you've your yours yourself yourselves
""".split()

READING_WORDS_PER_MINUTE = 200
SPEAKING_WORDS_PER_MINUTE = 130
CASE_STYLES = ("upper", "lower", "title", "sentence", "camel", "kebab", "snake", "constant")


def stats_column(text: Column | str) -> Column:
    """STRUCT of the eight counters of one text; NULL and empty texts count 0 everywhere."""
    n = unify_newlines(F.coalesce(col(text), F.lit("")))
    words = F.regexp_count(n, F.lit(WORD)).cast("bigint")
    filled = lambda parts: F.size(F.filter(parts, lambda p: ~is_blank(p))).cast("bigint")
    lines = F.when(n == "", 0).otherwise(F.length(n) - F.length(F.replace(n, F.lit("\n"), F.lit(""))) + 1)
    return F.struct(
        F.length(n).cast("bigint").alias("characters"),
        F.length(F.regexp_replace(n, WS + "+", "")).cast("bigint").alias("characters_no_spaces"),
        words.alias("words"),
        filled(F.split(js_trim(n), rf"[.!?]+(?={WS}|\z)", -1)).alias("sentences"),
        filled(F.split(n, rf"\n{WS}*\n", -1)).alias("paragraphs"),
        lines.cast("bigint").alias("lines"),
        F.ceil(words / READING_WORDS_PER_MINUTE).alias("reading_minutes"),
        F.ceil(words / SPEAKING_WORDS_PER_MINUTE).alias("speaking_minutes"),
    )


def text_stats(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, stats_column(text).alias("s")).select(*keep, "s.*")


def corpus_rollup(df: DataFrame, text: str, by: Sequence[str]) -> DataFrame:
    """Totals and the exact lower median of the word counts per group; every aggregate combines map-side.

    The median counts how often each word count occurs, so a group keeps a row per distinct count, not per text."""
    return text_stats(df, text, by).groupBy(*by).agg(
        F.count("*").alias("texts"), F.sum("characters").alias("characters"), F.sum("words").alias("words"),
        F.sum("sentences").alias("sentences"), F.sum("paragraphs").alias("paragraphs"),
        F.max("words").alias("max_words"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY words)").alias("median_words"),
    )


def recognized_text(text: Column | str) -> Column:
    """Paragraphs of collapsed, trimmed, non-empty lines; paragraphs joined by one blank line."""
    n = unify_newlines(text)
    line = lambda x: js_trim(F.regexp_replace(x, "[\t ]+", " "))
    block = lambda p: F.array_join(F.filter(F.transform(F.split(p, "\n", -1), line), lambda x: x != ""), "\n")
    paragraphs = F.filter(F.transform(F.split(n, rf"\n{WS}*\n", -1), block), lambda p: p != "")
    return F.array_join(paragraphs, "\n\n")


def ocr_text_metrics(df: DataFrame, text: str, by: Sequence[str]) -> DataFrame:
    """Characters and white-space separated words of the assembled text, summed per group."""
    t = df.select(*by, recognized_text(text).alias("t"))
    return t.groupBy(*by).agg(
        F.count("*").alias("texts"), F.sum(F.length("t")).alias("characters"),
        F.sum(F.regexp_count("t", F.lit(NOT_WS + "+"))).alias("words"),
    )


def _word_rows(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    words = F.regexp_extract_all(F.lower(col(text)), F.lit(WORD), 0)
    d = df.select(*keep, F.posexplode(words).alias("pos", "word"))
    # Length counts UTF-16 units, so a pair with a supplementary character is long enough.
    long = (F.length("word") > 2) | ((F.length("word") == 2) & F.col("word").rlike(r"[\x{10000}-\x{10ffff}]"))
    return d.filter(long & ~F.col("word").rlike(r"^\d+$") & ~F.col("word").isin(*STOP_WORDS))


def _share(count: Column, total: Column) -> Column:
    return js_round(count / total * 1000) / 10


def keywords(df: DataFrame, text: str, key: str, limit: int = 8) -> DataFrame:
    """Top words per text: (key, rank, word, count, percentage); ties by first appearance."""
    counts = _word_rows(df, text, [key]).groupBy(key, "word").agg(
        F.count("*").alias("count"), F.min("pos").alias("first_pos")
    )
    # Asking for the position too keeps both branches alike, so the counting shuffle is done once.
    totals = counts.groupBy(key).agg(F.sum("count").alias("total"), F.max("first_pos").alias("last")).filter("last >= 0").drop("last")
    # row_number under a small limit is pruned before the shuffle (window group limit).
    order = Window.partitionBy(key).orderBy(F.desc("count"), "first_pos")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return top.join(totals, key).select(
        key, "rank", "word", "count", _share(F.col("count"), F.col("total")).alias("percentage")
    )


def corpus_keywords(df: DataFrame, text: str, key: str, limit: int = 8) -> DataFrame:
    """The same report over all texts; words are pre-aggregated before the one shuffle on the word."""
    rows = _word_rows(df, text, [key])
    counts = rows.groupBy("word").agg(F.count("*").alias("count"), F.min(F.struct(key, "pos")).alias("first"))
    total = counts.agg(F.sum("count").alias("total")).withColumn("one", F.lit(1))
    top = counts.orderBy(F.desc("count"), "first").limit(limit).withColumn("one", F.lit(1))
    return top.join(total, "one").select(
        "word", "count", _share(F.col("count"), F.col("total")).alias("percentage")
    )


def _words(text: Column) -> Column:
    t = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    t = F.regexp_replace(t, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.split(F.trim(F.regexp_replace(t, r"[\W_]+", " ")), " +", -1)


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))


def convert_case(text: Column | str, style: str) -> Column:
    """One of CASE_STYLES; word characters are ASCII, so accented letters split or stay as they are."""
    t = col(text)
    if style == "upper":
        return F.upper(t)
    if style == "lower":
        return F.lower(t)
    if style == "title":
        pieces = F.regexp_extract_all(t, F.lit(rf"\w{NOT_WS}*|\W+"), 0)
        return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\w"), _capital(p)).otherwise(p)), "")
    if style == "sentence":
        low = F.lower(t)
        opener = rf"[.!?]{WS}+\w"
        pieces = F.regexp_extract_all(low, F.lit(rf"\A{WS}*\w|{opener}|[^.!?]+|[.!?]"), 0)
        raised = lambda p, i: ((i == 0) & p.rlike(rf"^{WS}*\w\z")) | p.rlike(rf"^{opener}\z")
        return F.array_join(F.transform(pieces, lambda p, i: F.when(raised(p, i), F.upper(p)).otherwise(p)), "")
    words = _words(t)
    if style == "camel":
        return F.array_join(
            F.transform(words, lambda w, i: F.when(i == 0, F.lower(w)).otherwise(_capital(w))), ""
        )
    if style == "kebab":
        return F.lower(F.array_join(words, "-"))
    if style == "snake":
        return F.lower(F.array_join(words, "_"))
    if style == "constant":
        return F.upper(F.array_join(words, "_"))
    raise ValueError(f"unknown style {style}")


def name_collisions(df: DataFrame, name: str, style: str = "snake") -> DataFrame:
    """Different raw names that fold to one standard name: (folded, raw_names, rows)."""
    # Two-step distinct count: rows fold to (folded, raw) pairs before the shuffle on folded.
    pairs = df.groupBy(convert_case(name, style).alias("folded"), F.col(name).alias("raw")).agg(F.count("*").alias("n"))
    return (
        pairs.groupBy("folded").agg(F.count("*").alias("raw_names"), F.sum("n").alias("rows"))
        .filter("raw_names > 1")
    )


def clean_text(
    text: Column | str, *, line_endings: bool = True, trim_lines: bool = True,
    duplicate_spaces: bool = True, empty_lines: bool = True,
) -> Column:
    """Four optional steps in a fixed order."""
    t = unify_newlines(text) if line_endings else col(text)
    lines = F.split(t, "\n", -1)
    if trim_lines:
        lines = F.transform(lines, js_trim)
    if duplicate_spaces:
        lines = F.transform(lines, lambda x: F.regexp_replace(x, "[ \t]+", " "))
    if empty_lines:
        lines = F.filter(lines, lambda x: ~is_blank(x))
    return F.array_join(lines, "\n")


def cleaning_report(df: DataFrame, text: str, by: Sequence[str], **options) -> DataFrame:
    """Rows changed and bytes saved per group."""
    d = df.select(*by, F.col(text).alias("a"), clean_text(text, **options).alias("b"))
    return d.groupBy(*by).agg(
        F.count("*").alias("texts"), F.sum((F.col("a") != F.col("b")).cast("bigint")).alias("changed"),
        F.sum(F.octet_length("a").cast("bigint")).alias("bytes_before"),
        F.sum(F.octet_length("b").cast("bigint")).alias("bytes_after"),
    )
