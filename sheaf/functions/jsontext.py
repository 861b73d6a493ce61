"""Strict JSON re-serialisation for one Arrow batch (a helper of the JSON operators).

The engine's VARIANT keeps 1000.0 and sorts keys, so the text form is produced here: insertion
order with integer-like keys first, shortest numbers, last duplicate wins.
"""

from __future__ import annotations

import json
import math
import re
from itertools import chain, repeat

import pandas as pd

_SURROGATE = re.compile("[\ud800-\udfff]")
_INDEX = re.compile(r"0|[1-9]\d{0,9}")


def number_text(x: float) -> str:
    """Shortest decimal text: exponents from 1e21 up and below 1e-6, no trailing .0, no -0."""
    if math.isinf(x) or math.isnan(x):
        return "null"
    if x == 0:
        return "0"
    mantissa, exponent = f"{x!r}".lower(), 0
    sign = "-" if mantissa.startswith("-") else ""
    mantissa = mantissa.lstrip("-")
    if "e" in mantissa:
        mantissa, e = mantissa.split("e")
        exponent = int(e)
    whole, _, fraction = mantissa.partition(".")
    fraction = "" if fraction == "0" else fraction
    digits = (whole + fraction).lstrip("0")
    point = len(whole) + exponent - (len(whole + fraction) - len(digits))
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    e = point - 1
    tail = f".{digits[1:]}" if n > 1 else ""
    return f"{sign}{digits[0]}{tail}e{'+' if e >= 0 else '-'}{abs(e)}"


def _text(s: str) -> str:
    return _SURROGATE.sub(lambda m: f"\\u{ord(m.group()):04x}", json.dumps(s, ensure_ascii=False))


def _scalar(v) -> str | None:
    """Text of a value that holds no others; None for the rest."""
    if v is None:
        return "null"
    if v is True or v is False:
        return "true" if v else "false"
    if isinstance(v, float):
        return number_text(v)
    if isinstance(v, str):
        return _text(v)
    if not v:
        return "{}" if isinstance(v, dict) else "[]"
    return None


def _members(v, colon: str):
    """(what stands before a member, member) of a container in output order."""
    if isinstance(v, list):
        return (("", x) for x in v)
    index = sorted((k for k in v if _INDEX.fullmatch(k) and int(k) < 2**32 - 1), key=int)
    chosen = set(index)
    return ((_text(k) + colon, v[k]) for k in index + [k for k in v if k not in chosen])


def _write(value, indent: int | None) -> str:
    """Text of a value of any depth; open containers wait on a stack."""
    colon = ":" if indent is None else ": "
    line = lambda depth: "" if indent is None else "\n" + " " * (indent * depth)
    out, stack = [], []

    def put(v) -> None:
        shown = _scalar(v)
        if shown is None:
            out.append("{" if isinstance(v, dict) else "[")
            stack.append((_members(v, colon), chain([""], repeat(",")), "}" if isinstance(v, dict) else "]"))
        else:
            out.append(shown)

    put(value)
    while stack:
        members, commas, end = stack[-1]
        found = next(members, None)
        if found is None:
            stack.pop()
            out.append(line(len(stack)) + end)
            continue
        out.append(next(commas) + line(len(stack)) + found[0])
        put(found[1])
    return "".join(out)


def _reject(name: str):
    raise ValueError(f"Unexpected token {name}")


_DECODER = json.JSONDecoder(parse_int=float, parse_float=float, parse_constant=_reject)
_SPACE = re.compile(r"[ \t\n\r]*")


def _decode_deep(text: str):
    """The decoder's result for texts nested deeper than it goes; only scalars are left to it."""
    skip = lambda i: _SPACE.match(text, i).end()
    fail = lambda message, i: json.JSONDecodeError(message, text, i)

    def name(i: int) -> tuple[str, int]:
        if text[i:i + 1] != '"':
            raise fail("Expecting property name enclosed in double quotes", i)
        key, i = _DECODER.scan_once(text, i)
        i = skip(i)
        if text[i:i + 1] != ":":
            raise fail("Expecting ':' delimiter", i)
        return key, skip(i + 1)

    top: list = []
    stack, keys, i = [top], [None], skip(0)
    while True:
        sign = text[i:i + 1]
        if sign in ("[", "{"):
            v, end = ([], "]") if sign == "[" else ({}, "}")
            i = skip(i + 1)
            empty = text[i:i + 1] == end
        else:
            try:
                v, i = _DECODER.scan_once(text, i)
            except StopIteration as e:
                raise fail("Expecting value", e.value) from None
            empty = True
        if isinstance(stack[-1], list):
            stack[-1].append(v)
        else:
            stack[-1][keys[-1]] = v
        if not empty:
            key = None
            if sign == "{":
                key, i = name(i)
            stack.append(v)
            keys.append(key)
            continue
        i = skip(i + 1 if sign in ("[", "{") else i)
        while len(stack) > 1 and text[i:i + 1] == ("]" if isinstance(stack[-1], list) else "}"):
            stack.pop()
            keys.pop()
            i = skip(i + 1)
        if len(stack) == 1:
            if i < len(text):
                raise fail("Extra data", i)
            return top[0]
        if text[i:i + 1] != ",":
            raise fail("Expecting ',' delimiter", i)
        i = skip(i + 1)
        if isinstance(stack[-1], dict):
            keys[-1], i = name(i)


def _decode(text: str):
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _decode_deep(text)


COLUMNS = ["ok", "root_type", "output", "message", "position", "line", "column"]


def _one(text: str, indent: int | None):
    try:
        v = _decode(text)
        root = (
            "null" if v is None else "array" if isinstance(v, list) else "object" if isinstance(v, dict)
            else "boolean" if isinstance(v, bool) else "number" if isinstance(v, float) else "string"
        )
        return True, root, _write(v, indent), None, None, None, None
    except json.JSONDecodeError as e:
        lines = re.split("\r\n|\r|\n", text[: e.pos])
        return False, None, None, e.msg, e.pos, len(lines), len(lines[-1]) + 1
    except ValueError as e:
        return False, None, None, str(e), None, None, None


def process(texts: pd.Series, indent: int | None) -> pd.DataFrame:
    rows = [(None,) * 7 if t is None else _one(t, indent) for t in texts]
    out = pd.DataFrame(rows, columns=COLUMNS)
    for c in ("position", "line", "column"):
        out[c] = out[c].astype("Int64")
    return out
