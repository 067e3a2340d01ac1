import os

import pytest

SF = os.environ.get("HOLDFAST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """A cohort with null ids, targets and texts, repeated rows and columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
    same = "one and the same text with a few more words in it to be long enough for every window of twenty words or so"
    rows = [
        (1, same, "a"), (1, same, "a"), (2, same + " end", "a"), (3, None, None), (4, "", "b"), (5, " \t\n", "b"),
        (None, same, "b"), (None, None, None), (6, long, "c"), (7, long + " tail", "c"), (8, "a " * 60, "a"), (9, "ünï ñ " * 40, None),
        (10, same, "b"),
    ]
    frame = spark.createDataFrame([(*r, 0, 1.5, "x") for r in rows], "id bigint, text string, stratum string, row int, value double, block string")
    return frame


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
