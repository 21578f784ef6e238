import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from samples import CLASHING, SCHEMA, prose

@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and blank texts, ties, copies, repeated rows, and one very long text."""
    base = prose(1, 400)
    rows = [(i, prose(i, 20 + 7 * i), "en", f"s{i % 3}", 1) for i in range(10, 30)]
    rows += [
        (1, base, "en", "s0", 1), (2, base, "en", "s1", 1), (3, base.replace(" ", "  \t", 5), "de", "s1", 1), (4, base + " tail end", None, None, None),
        (5, None, "en", "s0", None), (6, "", "en", None, 0), (7, " \n\t ", None, "s2", 4), (8, "single", "en", "s2", 6), (9, "a", None, "s2", 1),
        (None, "a text without a key", "en", "s1", 3), (None, None, None, None, None),
        (30, prose(77, 60_000), "en", "s2", 1), (31, "x" * 5_000 + " " + "#" * 3_000, "en", "s2", 1),
        (10, prose(10, 90), "en", "s1", 1), (10, prose(10, 90), "en", "s1", 1),
        (32, "don't  stop  now \U0001f600 Ünïcödé\r\n\x0b end\u0085", "en", "s0", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in edge_rows], SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
