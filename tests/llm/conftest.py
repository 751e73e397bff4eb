import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from conftest_llm import prose  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def odd_rows():
    """Null columns, empty and blank texts, a very long text, and repeated rows."""
    rng = random.Random(3)
    long = prose(rng, 60_000)
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (None, "no id here", "en", "a", 1), (3, " \t\n\x0b ", "en", "a", 5), (4, long, "en", "b", len(long)),
            (5, "same text of some words here again", "de", None, 3), (5, "same text of some words here again", "de", None, 3), (6, "same text of some words here again", "de", None, 3),
            (7, "Zoë's café naïve ß \U0001f600 é", "fr", "b", 9)]
    return rows


@pytest.fixture()
def docs_of(spark):
    return lambda rows: spark.createDataFrame(rows, DOCS)


@pytest.fixture()
def clashing():
    """Adds columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ["quality", "kept", "whole", "salt", "fence", "row_no", "gaps", "mentions", "parts", "fixed", "place", "nth", "at", "word", "n_tokens", "tie", "tokens", "a.b", "Fp"]
    return lambda df: df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
