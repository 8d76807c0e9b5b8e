import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and blank texts, one very long text, ties and copies."""
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three four five six"), (6, "one two three four five six"), (7, long), (8, long + " end"), (9, "é́ ﬁ 日本語 \U0001f600 <|endoftext|>"), (10, "0 1 2\n\n0 1 2")]
