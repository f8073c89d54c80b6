"""Registered queries of the portfolio operators: name -> (query, SQL for the same rows or None)."""

from __future__ import annotations

from shelfmark.plans import files, history, registry, results, scans, text


def all_plans() -> dict:
    found: dict = {}
    for module in (text, history, registry, results, files, scans):
        found |= module.PLANS
    return found
