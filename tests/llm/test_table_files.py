"""Small tables between steps are few files, for each file costs an executor a process of its own where permissions are set by one."""

import glob

import pytest

from apotheca.llm import minhash
from apotheca.llm.scratch import Table


@pytest.fixture
def many_parts(spark):
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_files_of_steps(many_parts, monkeypatch):
    spark, written = many_parts, []
    monkeypatch.setattr(Table, "drop", lambda self: written.append(self.path))
    rows = [(i, " ".join([f"w{i // 2}x{k}" for k in range(60)] + ["end"] * (i % 2))) for i in range(400)]
    got = minhash.duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.select("doc_id", "component_id").collect()} == {(i, i - i % 2) for i in range(400)}
    assert {path.rsplit("/", 1)[1].split("-")[0] for path in written} >= {"edges", "links", "sets", "buckets", "close"}
    for path in written:
        assert len(glob.glob(f"{path.removeprefix('file:')}/part-*")) <= 12, path


def test_many_rows_stay_dealt(many_parts):
    rows = many_parts.range(1000).repartition(40)
    for given, files in (((1000, 50), 20), ((1000, 10), 40), ((1000, 1 << 16), 12)):
        path = Table(rows, "rows", *given).path
        assert len(glob.glob(f"{path.removeprefix('file:')}/part-*")) == files
