import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from hostile import CLASHING, texts  # noqa: E402

@pytest.fixture(scope="session")
def docs(spark):
    """Hostile rows: repeated rows, null and repeated ids, columns with clashing names."""
    t = texts()
    rows = [(i, x) for i, x in enumerate(t)] + [(6, t[6]), (6, t[6]), (13, t[13]), (None, t[8]), (None, None), (23, t[23])]
    filled = [(i, x, *([None] * 10 if k % 3 == 0 else [k, "s", k, k, "l", "p", "v", k, "d", "w"])) for k, (i, x) in enumerate(rows)]
    df = spark.createDataFrame(filled, f"doc_id long, text string, {CLASHING}").repartition(5)
    df = df.persist()
    df.count()
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {CLASHING}")
