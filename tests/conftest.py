import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from rolefit.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "rolefit-tests", memory="4g")


@pytest.fixture(scope="session")
def values(spark):
    """Apply an expression to a list of values and return the results in order."""

    def apply(expression, inputs, kind="string"):
        rows = [(i, v) for i, v in enumerate(inputs)]
        frame = spark.createDataFrame(rows, f"i int, v {kind}")
        result = frame.select("i", expression.alias("r")).orderBy("i").collect()
        return [row.r for row in result]

    return apply
