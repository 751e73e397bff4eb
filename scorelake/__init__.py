"""Evaluation analytics on Spark: recorded model outputs in, scored rows, roll-ups and reports out."""

from scorelake.session import engine_session

__all__ = ["engine_session"]
