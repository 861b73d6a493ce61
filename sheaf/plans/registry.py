"""All registered queries and oracles, by operator family."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("reconciliation", "texts", "statements", "pages", "risks", "layouts", "ingest")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for family in FAMILIES:
        out.update(getattr(import_module(f"sheaf.plans.{family}"), attribute))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")
