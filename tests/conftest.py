import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


# sample, variant, gene, dose; the call of A1 in v1 is there twice
HAND_MADE = """
A1 v1 G1 1   A1 v1 G1 2   A2 v1 G1 2   A3 v2 G1 1   B1 v2 G1 1
A1 v3 G2 1   B1 v3 G2 1   B2 v3 G2 2
A1 v4 G3 2   A2 v4 G3 1   B2 v5 G3 1
A3 v6 G4 1   B3 v6 G4 1   B4 v6 G4 1
"""
CASES = "sample_id LIKE 'A%'"
CONTROLS = "sample_id LIKE 'B%'"


def calls_of(spark, text):
    words = text.split()
    rows = [
        (words[i], "1", int(words[i + 1][1:]), "A", "C", words[i + 2], int(words[i + 3]))
        for i in range(0, len(words), 4)
    ]
    return spark.createDataFrame(
        rows,
        "sample_id string, chr string, pos long, ref string, alt string, gene_symbol string,"
        " zygosity int",
    )


@pytest.fixture(scope="session")
def calls(spark):
    return calls_of(spark, HAND_MADE).cache()
