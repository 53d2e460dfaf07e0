"""Each general problem against its plain Python version over whole tables."""

import pyarrow.parquet as pq
import pytest

from marlstone.queries.core import QUERIES
from tests import brute

NAMES = "claims counter_claims claim_snapshots source_manifests thesis_nodes raw_claims tombstones ledger_writers".split()


@pytest.fixture(scope="module")
def tables(data):
    return {n: pq.read_table(f"{data}/{n}.parquet").to_pylist() for n in NAMES}


def got(spark, data, name, *columns):
    rows = QUERIES[name](spark, data).select(*columns).collect()
    out = {tuple(r) for r in rows}
    assert len(out) == len(rows), "rows come once"
    return out


def test_p1(spark, data, tables):
    assert got(spark, data, "p1_found", "ref_table", "ref_key", "ref_field", "target_key", "reason") == brute.p1(tables)


def test_p1_report_counts_every_reference(spark, data, tables):
    assert sum(r["n_references"] for r in QUERIES["p1_report"](spark, data).collect()) == len(brute.p1(tables))


def test_p2(spark, data, tables):
    assert got(spark, data, "p2_found", "record_id", "claim_id", "child", "pos", "child_key") == brute.p2(tables["raw_claims"])


def test_p3(spark, data, tables):
    assert got(spark, data, "p3_found", "claim_id", "status", "valid_from_us") == brute.p3(tables)


def test_p4(spark, data, tables):
    assert got(spark, data, "p4_found", "snapshot_id", "claim_id", "change") == brute.p4(tables)


def test_p6(spark, data, tables):
    assert got(spark, data, "p6_found", "node_id", "root_id", "depth") == brute.p6(tables["thesis_nodes"])


def test_p7(spark, data, tables):
    assert got(spark, data, "p7_found", "source_table", "record_key", "utc_us") == brute.p7(tables)


def test_p5(spark, data, tables):
    rows, registry = (pq.read_table(f"{data}/{n}.parquet").to_pylist() for n in ("claims_clean_crohns", "unit_registry"))
    assert got(spark, data, "p5_found", "claim_id", "canonical_unit", "canonical_value") == brute.p5(rows, registry)
