"""Helpers of these tests that are imported by name."""

import random


def prose(rng: random.Random, n: int, alphabet: str = "abcdefghijklmno") -> str:
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 8))) for _ in range(n))


def plan_of(df) -> str:
    """The physical plan as it is before any stage has run."""
    return df._jdf.queryExecution().executedPlan().toString()
