"""Text normalisation as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The ECMAScript white-space and line-terminator characters.
WHITESPACE = (
    "\t\n\u000b\f\r\u0020\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WS = r"[\t\n\x{0b}\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
NOT_WS = r"[^\t\n\x{0b}\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
TOKEN_CLASS = r"\p{L}\p{N}\p{M}_./-"
WORD = r"[\p{L}\p{N}_-]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c: Column | str) -> Column:
    """Trim Unicode white space on both ends (SQL trim strips blanks only)."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def _icu(c: Column, compatibility: bool) -> Column:
    # Spark ships ICU for collations; its normaliser is reached by reflection, so
    # the value never leaves the JVM.
    return F.call_function(
        "reflect",
        F.lit("com.ibm.icu.text.Normalizer"),
        F.lit("compose"),
        c,
        F.lit(compatibility),
    )


def nfc(c: Column | str) -> Column:
    """Unicode NFC. Code points below U+0300 are stable, so plain Latin text skips the call."""
    c = col(c)
    return F.when(c.rlike(r"[^\x{0}-\x{2ff}]"), _icu(c, False)).otherwise(c)


def nfkc(c: Column | str) -> Column:
    c = col(c)
    return F.when(c.rlike(r"[^\x{0}-\x{9f}]"), _icu(c, True)).otherwise(c)


def normalize_text(c: Column | str) -> Column:
    """NFC then trim; no case or punctuation folding. Never yields NULL for non-NULL input."""
    return js_trim(nfc(c))


def unify_newlines(c: Column | str) -> Column:
    return F.replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def is_blank(c: Column | str) -> Column:
    # Texts between "!" and DEL begin with a visible ASCII character; only others are trimmed to tell.
    c = col(c)
    return F.when((c >= "!") & (c < "\x7f"), F.lit(False)).otherwise(js_trim(c) == "")


def search_token(c: Column | str) -> Column:
    """NFKC, lower case, keep ASCII letters and digits."""
    return F.regexp_replace(F.lower(nfkc(c)), "[^a-z0-9]", "")


def js_round(c: Column) -> Column:
    """Half-up toward +infinity."""
    return F.floor(c + F.lit(0.5))
