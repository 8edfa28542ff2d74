import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import cases  # noqa: E402

from quire.llm.common import drop_scratch  # noqa: E402
from quire.session import share_code  # noqa: E402


@pytest.fixture(scope="session", autouse=True)
def shared(spark):
    share_code(spark)
    yield
    drop_scratch(spark)


@pytest.fixture(scope="session")
def docs(spark):
    return cases.documents(spark).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return cases.documents(spark, [])


@pytest.fixture(scope="session")
def clashing(docs):
    """The same documents with columns named as the operators name their own."""
    return docs.withColumns({c: F.lit(1) for c in ("size", "kept", "copies", "row_key", "_key", "_copies", "_h", "_row", "shard", "piece", "component", "_doc", "content", "features", "length")})
