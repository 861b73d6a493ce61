"""URL normalisation as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from sheaf.functions.text import js_trim


# Fixed pattern: scheme, credentials, host, port, path, query and fragment.
_URL = (
    r"^(?i)(https?):/*((?:[^/?#@\\]*@)?)([a-z0-9._~%\x{80}-\x{10ffff}-]+|\[[0-9a-f:.]+\])"
    r"(?::([0-9]{0,5}))?((?:[/\\][^?#]*)?)((?:\?[^#]*)?(?:#.*)?)$"
)


def _once(value: Column, build: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` one time however often ``build`` uses it."""
    return F.transform(F.array(value), build)[0]


def _normal(candidate: Column) -> Column:
    part = lambda i: F.regexp_extract(candidate, _URL, i)
    scheme, host, port = F.lower(part(1)), F.lower(part(3)), part(4)
    standard = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.when(part(5) == "", "/").otherwise(F.replace(F.replace(part(5), F.lit("\\"), F.lit("/")), F.lit(" "), F.lit("%20")))
    tail = F.replace(part(6), F.lit(" "), F.lit("%20"))
    out = F.concat(scheme, F.lit("://"), part(2), host, F.when(standard, "").otherwise(F.concat(F.lit(":"), port)), path, tail)
    valid = candidate.rlike(_URL) & ((port == "") | (F.coalesce(port.try_cast("int"), F.lit(0)) <= 65535))
    return F.when(valid, out)


def _with_scheme(v: Column) -> Column:
    return F.when(v.rlike(r"^(?i)[a-z][a-z0-9+.-]*:"), v).otherwise(F.concat(F.lit("https://"), v))


def website_url(value: Column | str) -> Column:
    """Normal form of an http(s) address, NULL when it is none.

    The scheme defaults to https, scheme and host are lower-cased, the default port is dropped and
    an empty path becomes ``/``."""
    return _once(_with_scheme(js_trim(value)), _normal)


def canonical(url: Column | str, origin: str) -> Column:
    """Resolve against ``origin``, refuse other origins (NULL), drop fragment and trailing slash."""
    origin = origin.rstrip("/")
    base = origin.lower() + "/"
    v = js_trim(url)
    absolute = (
        F.when(v.startswith("/") & ~v.startswith("//"), F.concat(F.lit(origin), v))
        .when(v.rlike(r"^(?i)[a-z][a-z0-9+.-]*:"), v)
        .otherwise(F.concat(F.lit(origin + "/"), v))
    )
    bare = F.regexp_replace(_once(absolute, _normal), "#.*$", "")

    def finish(u: Column) -> Column:
        root = u.rlike(r"^[a-z]+://[^/]+/(?:\?.*)?$")
        return F.when(F.startswith(u, F.lit(base)), F.when(root, u).otherwise(F.regexp_replace(u, "/$", "")))

    return _once(bare, finish)
