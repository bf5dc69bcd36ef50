"""Every registered query against its SQL, at the smallest scale."""

from __future__ import annotations

import os

import pytest

from registry import all_oracles, all_queries
from tests.oracle import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_agrees_with_sql(spark, duck, name):
    result = all_queries()[name](spark, SF_DIR).toArrow()
    assert differences(result, duck.execute(all_oracles()[name]).to_arrow_table()) is None


@pytest.mark.parametrize(
    "name", ["pack_sequences", "training_sequences", "shuffle_order", "latest_in_window", "knn_l2", "train_val_split_exact"]
)
def test_result_does_not_depend_on_partitions(spark, duck, name):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        result = all_queries()[name](spark, SF_DIR).toArrow()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert differences(result, duck.execute(all_oracles()[name]).to_arrow_table()) is None
