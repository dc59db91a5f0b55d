"""Serials that are parts of labels, and how many substrings are made for them."""

import random

import pytest

from apotheca.operators import catalogue


@pytest.mark.parametrize("most", [0, 10_000])
def test_serials_in_labels(spark, monkeypatch, most):
    monkeypatch.setattr(catalogue, "BEGINNINGS", most, raising=False)
    rng = random.Random(3)
    word = lambda low, high: "".join(rng.choice("ab_é") for _ in range(rng.randint(low, high)))
    boxes = [(rng.randint(0, 3), word(0, 9)) for _ in range(60)] + [(1, None), (None, "ab")]
    scans = [(i, rng.randint(0, 4), word(2, 5)) for i in range(300)] + [(300, 1, ""), (301, 4, ""), (302, 1, None), (303, None, "ab")]
    found = catalogue.contained_duplicates(spark.createDataFrame(scans, "id int, key int, serial string"), spark.createDataFrame(boxes, "key int, label string"), "key", "serial", "label")
    want = [i for i, k, s in scans if k is not None and s is not None and any(key == k and label is not None and s in label for key, label in boxes)]
    assert sorted(r.id for r in found.collect()) == want


def test_no_empty_serial_and_none_at_all(spark):
    boxes = spark.createDataFrame([(1, "ab")], "key int, label string")
    rows = lambda *x: spark.createDataFrame(list(x), "id int, key int, serial string")
    assert [r.id for r in catalogue.contained_duplicates(rows((1, 1, ""), (2, 2, "")), boxes, "key", "serial", "label").collect()] == [1]
    assert catalogue.contained_duplicates(rows(), boxes, "key", "serial", "label").count() == 0


def test_only_substrings_that_begin_as_serials_do_are_made(spark):
    """Forty labels of a hundred letters: one substring of each begins as the serials do, and 4950 don't."""
    boxes = spark.createDataFrame([(1, f"{i:02}" + "x" * 50 + "_5" + "y" * 46) for i in range(40)], "key int, label string")
    scans = spark.createDataFrame([(1, 1, "_5"), (2, 1, "_5yz"), (3, 1, "_5" + "y" * 46), (4, 2, "_5")], "id int, key int, serial string")
    found = catalogue.contained_duplicates(scans, boxes, "key", "serial", "label")
    assert sorted(r.id for r in found.collect()) == [1, 3]
    plan = found._jdf.queryExecution().executedPlan()
    made = max(n.metrics().apply("numOutputRows").value() for n in nodes(plan) if n.nodeName() == "Generate")
    assert made <= 40 * 99


def nodes(plan):
    kids = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if plan.nodeName().endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    return [plan, *(n for kid in kids for n in nodes(kid))]
