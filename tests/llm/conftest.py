import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls, empty and long texts, copies, ties, a repeated row and columns with clashing names."""
    prose = " ".join(f"word{i % 97} and{i % 31} more{i % 13}" for i in range(200))
    rows = [
        (1, prose, "en", "a", len(prose)),
        (2, prose.replace(" ", "\n"), "en", "a", 1),
        (3, prose + " end", "en", None, None),
        (4, "", None, "b", 0),
        (5, None, "de", "b", None),
        (6, " \t\n", "de", "b", 3),
        (7, "one two", "fr", "c", 7),
        (7, "one two", "fr", "c", 7),
        (None, "one  two", "fr", "c", 8),
        (8, "x" * 50_000, "en", "a", 50_000),
        (9, "Ünïcode — text 日本語 ### $$$ | | |\n" * 40, "es", "d", 9),
        (10, prose.upper() + "!!", "en", "a", 5),
    ]
    return spark.createDataFrame([(*r, "n", 1, True) for r in rows], SCHEMA + ", stays string, grp int, kept boolean")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (9, 0, 0), (10, 0, 1), (4, None, None), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
