"""Named queries and their SQL counterparts."""
from __future__ import annotations

from loomtext.plans.queries import REGISTRY


def queries() -> dict:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
