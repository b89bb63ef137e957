import pytest
from cases import DOCS, awkward_rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS)


@pytest.fixture(scope="session")
def clashing(awkward):
    """The same with further columns, named like ones that operators use."""
    from pyspark.sql import functions as F

    names = ["shard", "slot", "size", "kept", "score", "digest", "salt", "node", "label", "spans", "k1", "k2", "n", "law", "item_id", "distance", "perplexity", "target", "taken", "src", "_text", "_copies", "_leak", "_lang"]
    return awkward.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
