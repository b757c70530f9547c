import logging
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from social import SOCIAL  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("trefoil-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    logging.getLogger("DataFrameQueryContextLogger").setLevel(logging.CRITICAL)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def social(spark):
    from trefoil import Graph

    return Graph(spark.createDataFrame(SOCIAL, "sub string, prop string, obj string"))


def brute_force(triples, patterns, filters=()):
    """All bindings of a pattern list, by trying every triple for every pattern."""
    answers = [{}]
    for p in patterns:
        found = []
        for bound in answers:
            for triple in triples:
                new = dict(bound)
                if all(
                    new.setdefault(term, value) == value if term.startswith("?") else term == value
                    for term, value in zip(p, triple)
                ):
                    found.append(new)
        answers = found
    return [
        a for a in answers
        if all(a.get(x, x) != a.get(y, y) for x, _, y in filters)
    ]


@pytest.fixture(scope="session")
def solve():
    return brute_force
