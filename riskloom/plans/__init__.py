"""Named queries over the given tables and the SQL they must agree with."""

from __future__ import annotations

from riskloom.plans.registry import QUERIES, Query


def all_queries() -> dict[str, Query]:
    """All named queries, registered by importing their modules."""
    from riskloom.plans import credit_model_queries, load_queries, model_queries, profile_queries, star_queries  # noqa: F401

    return dict(QUERIES)
