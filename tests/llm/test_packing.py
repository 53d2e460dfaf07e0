"""Packing: nothing lost, nothing over capacity, little unused."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import packing


def check(windows, sizes, capacity):
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= capacity for w in windows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=40))
def test_windows_hold_all_items(sizes):
    windows, _ = packing.windows_of(sizes, 50)
    check(windows, sizes, 50)
    assert len(windows) <= len(packing.best_fit(sizes, 50))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=30), st.integers(1, 8))
def test_differencing_is_near_equal(sizes, k):
    found = packing.difference_partition(sizes, k)
    assert len(found) == k
    assert sorted(i for w in found for i in w) == list(range(len(sizes)))
    sums = [sum(sizes[i] for i in w) for w in found]
    assert max(sums) - min(sums) <= max(sizes)  # no worse than any greedy partition


def test_known_partition():
    sums = sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.difference_partition([8, 7, 6, 5, 4], 2))
    assert sums == [14, 16]


def test_many_small_items_leave_little_room():
    rng = random.Random(3)
    sizes = [min(2048, int(rng.lognormvariate(5, 1)) + 1) for _ in range(2000)]
    windows, evened = packing.windows_of(sizes, 2048)
    assert evened
    check(windows, sizes, 2048)
    assert len(windows) <= math.ceil(sum(sizes) / 2048) + 1


def test_pack(spark):
    rows = [(1, 0), (2, None), (3, 5), (4, 10), (5, 11), (6, 35), (7, 3), (8, 7), (9, -4)]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    out = packing.pack(items, [("ten", 10), ("none", None), ("zero", 0)]).collect()
    boxes = {}
    for r in out:
        assert r["container_kind"] == "ten"
        boxes[r["container_id"]] = boxes.get(r["container_id"], 0) + r["length"]
    assert max(boxes.values()) == 10
    held = {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == held.get(r["doc_id"], 0)
        held[r["doc_id"]] = r["start"] + r["length"]
    assert held == {k: max(0, n or 0) for k, n in rows}
    pieces = {k: sum(r["doc_id"] == k for r in out) for k, _ in rows}
    assert all(pieces[k] == 1 for k, n in rows if (n or 0) <= 10) and pieces[5] == 2 and pieces[6] == 4
    assert len(boxes) == 8  # 71 units in windows of ten


def test_empty(spark):
    items = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert packing.pack(items, [("ten", 10)]).collect() == []
    assert packing.pack(items, []).collect() == []


@pytest.mark.parametrize("capacity", [512, 2048, 8192])
def test_documents_fill_their_containers(spark, data, capacity):
    from marlstone.llm.tokens import token_counts

    counts = token_counts(spark.read.parquet(f"{data}/documents.parquet")).cache()
    total = counts.agg({"n_tokens": "sum"}).first()[0]
    packed = packing.pack(counts, [("x", capacity)])
    report = packing.fill_report(packed).first()
    assert report["n_tokens"] == total and report["fullest"] <= capacity
    assert report["n_containers"] <= math.ceil(total / capacity) * 1.02 + 2
    assert packed.select("doc_id").distinct().count() == counts.count()
