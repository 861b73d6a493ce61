"""URL verdicts from pattern rules that are found through their rarest literal token, in DataFrame functions only.

Pattern syntax, matched against the host in lower case with all that follows it: ``||`` at the start stands for the
start of the host or of one of its parent domains, ``|`` at either end for the end of the address, ``*`` for any
characters, ``^`` for a character other than letter, digit, ``_``, ``-``, ``.``, ``%``, or the end. All else is literal.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sheaf.session import stage

#: (shown, pattern, verdict) of host and path rules
HOST_RULES = tuple((r, f"||{r}", v) for r, v in (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
))
#: (pattern, verdict) where no host rule fits: addresses that lead to no text worth reading, or to a text again
PATTERN_RULES = (
    ("/login^", "block"), ("/signin^", "block"), ("/register^", "block"), ("/cart^", "block"), ("/checkout^", "block"),
    ("/wp-admin/", "block"), ("/wp-login.php", "block"), ("/cgi-bin/", "block"), ("/tag/*/page/", "block"), ("^print=1^", "block"),
    ("^sessionid=", "block"), ("^phpsessid=", "block"), ("^replytocom=", "block"), ("^utm_source=", "block"), ("||ads.", "block"),
    ("||adserver.", "block"), (".jpg^", "block"), (".png^", "block"), (".gif^", "block"), (".zip^", "block"), (".exe^", "block"),
    (".mp4^", "block"), (".css^", "block"), (".js^", "block"), ("/robots.txt|", "block"), ("/feed/|", "block"),
)

#: Tasks that share the addresses of one token.
SALTS = 16


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def url_parts(url: Column) -> dict[str, Column]:
    """host, path and target (host with all that follows); all empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    tail = F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)
    return {"host": host, "path": F.regexp_extract(tail, r"(?s)^([^?#]*)", 1), "target": F.concat(host, tail)}


def tokens(c: Column) -> Column:
    """Distinct runs of ASCII letters and digits, lower-cased, and the empty token that every text has."""
    return F.array_union(F.array(F.lit("")), F.regexp_extract_all(lower_ascii(c), F.lit("[a-z0-9]+"), F.lit(0)))


def pattern_regex(pattern: Column) -> Column:
    p = F.regexp_replace(pattern, r"([\\.+?(){}\[\]$])", r"\\$1")
    p = F.regexp_replace(p, r"\^", r"(?:[^\\w.%-]|\\z)")
    p = F.regexp_replace(p, r"\*", ".*")
    p = F.regexp_replace(p, r"^\|\|", r"^(?:[^/?#]*\\.)?")
    p = F.regexp_replace(p, r"^\|", "^")
    return F.concat(F.lit("(?s)"), F.regexp_replace(p, r"\|$", r"\\z"))


def rule_tokens(pattern: Column) -> Column:
    """Literal tokens that any matching text must hold as whole tokens: neither end may touch ``*`` or an open pattern end."""
    return F.regexp_extract_all(lower_ascii(pattern), F.lit(r"(?<=[^*a-z0-9])[a-z0-9]+(?=[^*a-z0-9])"), F.lit(0))


def rules_table(spark: SparkSession, host_rules: Sequence[tuple[str, str, str]] = HOST_RULES,
                pattern_rules: Sequence[tuple[str, str]] = PATTERN_RULES) -> DataFrame:
    rows = [(0, shown, p, v) for shown, p, v in host_rules] + [(1, None, p, v) for p, v in pattern_rules]
    return spark.createDataFrame(rows, "rank int, shown string, pattern string, verdict string")


def judge(df: DataFrame, rules: DataFrame | None = None, url: str = "url", page_id: str = "page_id", default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule and verdict of every row.

    ``rules`` (rank, shown, pattern, verdict): the least rank among the fitting rules counts, then the longest
    pattern; ``rule`` is its shown name, null for pattern rules. Each rule is indexed by that of its literal tokens
    which the fewest addresses hold; a rule without one is indexed by the empty token, which all addresses hold.
    Distinct addresses fetch rules by token, and only those run their expressions.

    Null and malformed addresses have empty host and path; only a rule that fits the empty text can match them, else
    they get ``default``. Repeated rows each give a row; an empty table gives an empty result; other columns aren't read."""
    spark = df.sparkSession
    rules = rules_table(spark) if rules is None else rules
    pages = df.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    parts = url_parts(F.col("url"))
    known = stage(pages.select(F.coalesce("url", F.lit("")).alias("address")).distinct().select(
        "address", *[c.alias(n) for n, c in url_parts(F.col("address")).items()]))
    posted = known.select("address", F.explode(tokens(F.col("target"))).alias("token"))
    ruled = rules.select(F.struct("rank", (-F.length("pattern")).alias("shorter"), "pattern", "shown", "verdict").alias("r"),
                         pattern_regex(F.col("pattern")).alias("regex"), rule_tokens(F.col("pattern")).alias("literals"))
    literals = ruled.select("r", "regex", F.explode_outer("literals").alias("token")).withColumn("token", F.coalesce("token", F.lit("")))
    held = posted.groupBy("token").agg(F.count("*").alias("n")).join(literals.select("token").distinct(), "token")
    index = (literals.join(held, "token", "left").groupBy("r", "regex")
             .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token")))
    # a token may be in very many addresses: it is dealt to several tasks, and its few rules to each of them
    salted = posted.withColumn("salt", F.pmod(F.xxhash64("address"), F.lit(SALTS)).cast("int"))
    index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    candidates = salted.join(index, ["token", "salt"]).join(known.select("address", "target"), "address")
    best = (candidates.where("target RLIKE regex").groupBy("address").agg(F.min("r").alias("r")))
    return pages.join(best.withColumnRenamed("address", "a"), F.coalesce("url", F.lit("")) == F.col("a"), "left").select(
        "page_id", "url", parts["host"].alias("host"), parts["path"].alias("path"), F.col("r.shown").alias("rule"),
        F.coalesce("r.verdict", F.lit(default)).alias("verdict"))
