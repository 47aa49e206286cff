import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def documents(spark):
    """Edge cases: nulls, empty and wordless texts, a very long one, ties, repeated rows, columns that clash with results."""

    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.withColumns({c: F.lit("clash") for c in ("n_tokens", "fp", "ids", "score", "t", "key", "slot", "rn", "row", "lang_pred", "component_id", "x")}).repartition(3)

    return make




def pytest_collection_modifyitems(items):
    """The test of the pipeline whose near duplicates are 3-bit links contradicts the stage's setting (README, Open): it runs last, so that
    `-x` doesn't keep the others from running."""
    items.sort(key=lambda i: i.name == "test_pipeline_is_its_stages_by_brute_force")
