"""Every registered query against its SQL, and independence of the partitioning."""

import pytest

from marginalia.plans.catalog import CATALOG
from tests.compare import bag, database, difference
from tests.conftest import DATA


@pytest.fixture(scope="module")
def con():
    return database(DATA)


@pytest.mark.parametrize("name", list(CATALOG))
def test_query_matches_sql(spark, con, name):
    query, sql = CATALOG[name]
    assert difference(spark, con, DATA, query, sql) is None


@pytest.mark.parametrize("name", ["keyword_topk", "cosine_topk_per_label", "late_event_guard", "audit_pack", "row_sentences", "chunk_cleaned_documents"])
def test_partitioning_does_not_matter(spark, name):
    query, _ = CATALOG[name]
    seen = []
    for width in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        frame = query(spark, DATA)
        seen.append(bag(frame.columns, frame.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]
