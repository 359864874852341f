"""All queries of the document operators."""

from __future__ import annotations

from quire.plans import assets, checks, pages, text
from quire.plans.registry import Query

QUERIES: dict[str, Query] = text.QUERIES | pages.QUERIES | checks.QUERIES | assets.QUERIES
