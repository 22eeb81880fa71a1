"""A few queries of each part against their SQL; the driver compares them all."""

import os

import duckdb
import pytest

from ontoloom.operators import roles
from ontoloom.plans import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["scan_axioms_by_kind", "segment_composite_include", "restriction_sub", "equivalent_union", "annotation_edges", "object_assertion", "domain_range", "hashset_order", "role_state_subroles", "encounter_order", "diagnostics", "edge_json", "java_hash"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    got = con.execute(q.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    assert found == sorted((tuple(r[names.index(c)] for c in columns) for r in got.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["role_subroles_join", "restriction_super"])
def test_filters_of_join_keys_hold_no_python(spark, monkeypatch, name):
    """As with tables that seem large, where Spark looks keys up in a Bloom filter, in a subquery, before it joins."""
    monkeypatch.setattr(roles, "BROADCAST_BYTES", -1)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        test_same_rows(spark, name)
    finally:
        for k in settings:
            spark.conf.unset(k)
