"""Words beside letters beyond ASCII: borders of words as the queries' SQL has them."""

from __future__ import annotations

import duckdb
import pytest
from compare import rows
from pyspark.sql import functions as F

from veritrail import catalog
from veritrail.functions import text as T

TURNS = [
    (1, 0, "user", "Was ist das?"), (1, 1, "assistant", "Erste Angaben hier. Zweite Angaben dort. Dritte Angaben da. Erheit öbe. Die Stadt liegt am Meer."),
    (2, 0, "user", "Qué es?"), (2, 1, "assistant", "Noñbogación galldo, adoue. Un lugar grande. Otra cosa más."), (2, 2, "user", "Und?"), (2, 3, "assistant", "Erheit öbe."),
]


@pytest.fixture(scope="module")
def turns(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("borders"))
    spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.mark.parametrize("name", ["T06_normalize_claim", "T08_filter_factual", "T09_extract_claims", "T10_grounded_filter", "T14_span_coverage", "T26_claim_importance"])
def test_borders_match_sql(spark, turns, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{turns}/conversations.parquet/*.parquet'")
    mine, other = catalog.queries()[name](spark, turns).toPandas(), c.sql(catalog.oracle_sql()[name]).df()
    assert rows(mine) == rows(other)


def test_borders(spark):
    one = lambda v, f: spark.createDataFrame([(v,)], "t string").select(f(F.col("t")).alias("x")).first().x
    assert one("There is no evidence suggesting noñbogación galldo.", T.normalize_claim) == "Noñbogación galldo."
    assert one("Erheit öbe.", T.is_factual)
    assert one("Erheit öbe.", T.extract_claims) == ["Erheit öbe."]
