"""Registered queries over the test tables and the SQL each must agree with."""

from __future__ import annotations


def all_queries() -> dict:
    from talkmill.checks import job_queries, learning_queries, matching_queries, state_queries, table_queries, text_queries, whole_jobs  # noqa: F401 - they register their queries
    from talkmill.checks.registry import REGISTRY

    return dict(REGISTRY)
