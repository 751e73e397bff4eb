"""All registered queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import scorelake.plans.queries_io  # noqa: F401 - registers its queries
import scorelake.plans.queries_rows  # noqa: F401
import scorelake.plans.queries_scores  # noqa: F401
import scorelake.plans.queries_stats  # noqa: F401
import scorelake.plans.queries_streams  # noqa: F401
import scorelake.plans.queries_text  # noqa: F401
from scorelake.plans.registry import CHECKS, QUERIES, runnable


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runnable(fn) for name, fn in QUERIES.items()}


def all_checks() -> dict[str, str]:
    return dict(CHECKS)
