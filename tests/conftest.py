import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tallyboard-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def refreshed(spark):
    """Import and full refresh of the sf0.01 tables."""
    from tallyboard.plans.refresh import refresh_all
    from tallyboard.session import materialise
    from tallyboard.sources import importer, retail

    imported = importer.import_dump(retail.dump(spark, str(TESTDATA / "sf0.01")))
    imported = {name: materialise(df, name) for name, df in imported.items()}
    tables = refresh_all(imported)
    tables["leaderboards"] = materialise(tables["leaderboards"], "boards")
    return imported, tables
