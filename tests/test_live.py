"""Similarity joins, versioned tables, views that follow changes, and decisions on a stream, against brute force."""

import json
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from apotheca.operators import similarity
from apotheca.plans.live import rocksdb
from apotheca.sources.versions import BucketedTable
from apotheca.streaming import decisions, upserts


def words(rng, n):
    return ["".join(rng.choice("abcde ") for _ in range(rng.randrange(14))) for _ in range(n)]


def test_jaro_winkler_is_the_database_s():
    rng = random.Random(4)
    a, b = words(rng, 3000), words(rng, 3000)
    a += ["", "x", "x", "abcd", "martha", "ab" * 60]
    b += ["", "x", "y", "", "marhta", "ba" * 60]
    rows = pd.DataFrame({"a": a, "b": b})  # noqa: F841
    want = [r[0] for r in duckdb.sql("select jaro_winkler_similarity(a, b) from rows").fetchall()]
    assert similarity.jaro_winkler(a, b).tolist() == pytest.approx(want, abs=1e-12)


def plain_grams(name, q=3):
    padded = f" {name.lower()} "
    return {padded[i : i + q] for i in range(max(len(padded) - q + 1, 1))}


@pytest.mark.parametrize(("share", "cut"), [(0.3, 5000), (0.5, 3), (1.0, 2)])
def test_no_similar_pair_is_lost(spark, share, cut):
    rng = random.Random(8)
    left, right = set(words(rng, 150)), set(words(rng, 150))
    rows = lambda names: spark.createDataFrame([(n,) for n in names] * 2 + [(None,)], "name string")
    got = {tuple(r) for r in similarity.similar_names(rows(left), rows(right), share, cut=cut).collect()}
    grams = {n: plain_grams(n) for n in left | right}
    assert got == {(a, b) for a in left for b in right if len(grams[a] & grams[b]) >= share * len(grams[a] | grams[b]) - 1e-9}


def test_orphans_get_the_group_that_is_most_like_them(spark):
    groups = [(1, "ABILIFY", "comprimé"), (2, "ABILIFY", "sirop"), (3, "DOLIPRANE", "comprimé"), (4, "DOLIPRANE", "comprimé"), (5, None, "sirop"), (6, "XANAX", None)]
    orphans = [("a", "ABILIFY 10 mg", "comprimé", 0), ("b", "ABILIFY", "sirop", 0), ("c", "DOLIPRAN", "comprimé", 0), ("d", "ZZZ", "comprimé", 0), ("e", None, "sirop", 0), ("f", "", None, 0), ("a", "ABILIFY 10 mg", "comprimé", 0), ("g", "XANAX", None, 0)]
    found = similarity.attach(spark.createDataFrame(orphans, "id string, name string, form string, score2 int"), spark.createDataFrame(groups, "group_id int, name string, form string"), least=0.7)
    assert sorted((r.id, r.group_id) for r in found.collect()) == [("a", 1), ("a", 1), ("b", 2), ("c", 3), ("d", None), ("e", None), ("f", None), ("g", 6)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    empty = spark.createDataFrame([], "group_id int, name string, form string")
    assert [r.group_id for r in similarity.attach(spark.createDataFrame(orphans, "id string, name string, form string, score2 int"), empty).collect()] == [None] * 8


def test_a_batch_counts_once(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/t", "k long, stock_count long, name string, updated_at long, first_at struct<ts:long,id:long>", ["k"], buckets=8)
    stock = upserts.Stock(table, "k", "n", ["ts", "id"], ["name"])
    batch = lambda *rows: spark.createDataFrame(rows, "k long, n long, name string, ts long, id long")
    one, two = batch((1, 2, "b", 5, 1), (1, 3, "a", 4, 2), (2, 1, "x", 1, 3)), batch((1, 1, "first", 1, 9), (3, 7, "n", 2, 4))
    state = lambda: sorted((r.k, r.stock_count, r.name, r.updated_at) for r in table.read().collect())
    assert table.read().collect() == []
    stock.merge(one, 0)
    assert stock.merge(one, 0) is None and state() == [(1, 5, "a", 5), (2, 1, "x", 1)]
    before = table.folders()
    touched = stock.merge(two, 1)
    assert state() == [(1, 6, "first", 5), (2, 1, "x", 1), (3, 7, "n", 2)]
    assert stock.merge(one, 0) is None and stock.merge(two, 1) is None and table.version() == 2
    after = table.folders()
    assert {b for b in after if after[b] != before.get(b)} == set(touched) and set(touched) < set(before) | set(touched)
    stock.merge(batch(), 2)
    table.vacuum(1)
    assert state() == [(1, 6, "first", 5), (2, 1, "x", 1), (3, 7, "n", 2)] and table.version() == 3
    with pytest.raises(RuntimeError):
        table._commit({}, 3)


def test_a_view_follows_inserts_changes_and_deletes(spark, tmp_path):
    rng = random.Random(2)
    view, rows = upserts.ClusterView(spark, f"file://{tmp_path}/v", "c", "long", "long", buckets=8), {}
    for number in range(5):
        changes = []
        for _ in range(40 if number < 4 else 0):
            key = rng.randrange(60)
            if key in rows:
                changes.append((*rows.pop(key), -1))
            if rng.random() < 0.7:
                rows[key] = (rng.randrange(12) if rng.random() < 0.6 else 99, rng.randrange(5))
                changes.append((*rows[key], 1))
        if number == 4:
            gone = [k for k in rows if rows[k][0] == 99]
            changes = [(*rows.pop(k), -1) for k in gone]
        table = spark.createDataFrame(changes, "c long, value long, sign int")
        before = view.view.folders()
        touched = view.merge(table, number)
        assert view.merge(table, number) is None
        after = view.view.folders()
        assert all(after.get(b) == f for b, f in before.items() if b not in touched)
        want = sorted((c, len(v), min(v), max(v)) for c in {r[0] for r in rows.values()} if (v := [x for k, x in rows.values() if k == c]))
        assert sorted(map(tuple, view.view.read().collect())) == want
    assert len(touched) == 1


RULES = decisions.Rules(cooldown=5, lifetime=20, delay=4, capacity=2, remember=60, slot=10)


def scan_rows(n=260):
    rng = random.Random(6)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 1, 1, 3, 9, 30])
        rows.append((rng.choice([1, 1, 1, 2]), t, i, rng.random() < 0.9, rng.random() < 0.8, rng.random() < 0.5, rng.random() < 0.3, rng.choice("abcd"), rng.choice(["x", "y", "z", None]), rng.choice([0, 0, 8])))
    return rows


SCANS = "k long, ts timestamp, tie long, readable boolean, known boolean, restock boolean, forced boolean, item string, box string, busy_seconds long"


def run_decisions(spark, folder, batches, rows):
    schema = SCANS.replace("ts timestamp", "ts long")
    for number, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.parquet(f"{folder}/in/b={number}")
    source = spark.readStream.schema(SCANS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    with rocksdb(spark):
        stream = decisions.decide_stream(source, "k", "100 seconds", RULES).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        stream.awaitTermination()
    kept = [sum(o["numRowsTotal"] for o in json.loads(p.json)["stateOperators"]) for p in stream.recentProgress if json.loads(p.json)["stateOperators"]]
    return {(r.k, r.tie): r.decision for r in spark.read.parquet(f"{folder}/out").collect()}, kept


def plain_decisions(rows):
    out, known, boxes = {}, {}, {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        scan = dict(zip(("k", "t", "tie", "readable", "known", "restock", "forced", "item", "box", "busy_seconds"), row, strict=True), t=row[1] * 1_000_000)
        out[row[0], row[2]] = decisions.decide_scan(known.setdefault(row[0], decisions.Known()), boxes.setdefault(row[0], {}), scan, RULES)
    return out


def test_decisions_do_not_depend_on_batches_and_state_shrinks(spark, tmp_path):
    rows = scan_rows()
    last = max(r[1] for r in rows)
    end = [(3, last + 10_000, 10_000, True, True, False, False, "a", None, 0)]
    later = [(3, last + 20_000, 10_001, True, True, False, False, "a", None, 0)]
    want = plain_decisions(rows)
    assert set(want.values()) == {"warning", "ignored", "not_found", "duplicate", "added", "success", "replaced"}
    shuffled = rows[:130]
    random.Random(1).shuffle(shuffled)
    for name, batches in (("one", [shuffled + rows[130:], end, later]), ("many", [shuffled, rows[130:180], rows[180:], end, later])):
        got, kept = run_decisions(spark, f"file://{tmp_path}/{name}", batches, rows)
        assert {k: v for k, v in got.items() if k[0] != 3} == want
        assert max(kept) > 20 and kept[-1] <= 3


def test_one_decision_after_the_other():
    known, boxes, at = decisions.Known(), {}, 0

    def scan(t, **more):
        row = {"t": t * 1_000_000, "readable": True, "known": True, "restock": False, "forced": False, "item": "a", "box": None, "busy_seconds": 0}
        return decisions.decide_scan(known, boxes, row | more, RULES)

    assert scan(0, readable=False) == "warning" and known.last is None
    assert [scan(0), scan(4, item="b"), scan(5, item="b")] == ["success", "ignored", "success"]
    assert scan(10) == "ignored" and scan(10, forced=True) == "replaced"
    assert scan(20, restock=True, box="x", busy_seconds=30) == "added"
    assert scan(40, item="c") == "ignored" and scan(41, restock=True, box="x", forced=True) == "duplicate"
    assert scan(90, restock=True, box="x") == "added" and scan(100, known=False, item="d") == "not_found"
    # A list of two: the third pushes the oldest out, which may be scanned again at once.
    assert [scan(t, item=i) for t, i in ((110, "a"), (115, "b"), (120, "c"), (125, "a"), (131, "c"))] == ["success", "success", "success", "success", "ignored"]
    # After its life an item leaves the list, and is released after the delay.
    assert scan(147, item="a") == "ignored" and scan(152, item="a") == "success"
