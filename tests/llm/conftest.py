import os

import pytest
from pyspark.sql import functions as F

os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), os.environ.get("PYTHONPATH", "")])

KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, y int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names clash with internal ones."""
    long = " ".join(f"word{i % 977} and {i}" for i in range(20_000))
    base = "the quick brown fox jumps over the lazy dog near the old stone bridge while seven ravens watch from the roof of a mill " * 2
    rows = [(1, base, "en", "a", 1, 0.5, "x", 1), (1, base, "en", "a", 1, 0.5, "x", 1), (2, base.upper(), None, None, None, None, None, None),
            (3, None, "en", "a", 0, None, None, None), (4, "", "en", "a", 0, None, None, None), (None, base, "en", "a", 9, None, None, None),
            (5, "lone short text", "de", "b", 15, None, None, None), (6, "é ü ñ " * 60, "fr", "b", 360, None, None, None), (7, long, "en", "c", len(long), None, None, None),
            (8, "!!! ??? ...", "en", "c", 11, None, None, None)]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where(F.lit(False))


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
