import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    yield session
    session.stop()


@pytest.fixture
def found(spark, tmp_path):
    """found(query, table=(schema, rows), ...): the rows that the query gives for these tables."""
    import __spark_entry__

    def run(query, **tables):
        for name, (schema, rows) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return sorted((tuple(r) for r in __spark_entry__.queries()[query](spark, str(tmp_path)).collect()), key=repr)

    return run
