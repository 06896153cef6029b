"""Named queries against their SQL on the smallest data set; check_oracles.py runs all of them on larger ones."""
import os

import duckdb
import pytest

import __spark_entry__ as entry
import check_oracles
import oracle_queries
from showerframe.plans import catalog

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(oracle_queries.oracles()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["scan_truth_cells", "event_slice", "trackster_owner", "ideal_quality", "merged_targets",
                                  "evaluate_sums", "neighbour_pairs", "cluster_labels_lc", "partition_compare"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in check_oracles.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = check_oracles.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert result.startswith("ok"), result


def test_entry_has_all_metrics(spark):
    assert entry.entry(spark).count() == 46
