"""Windows of a task are one row where they are equal, in whichever block they are."""

from collections import Counter

import pyarrow as pa
import pytest

from apotheca.llm import collocations


@pytest.mark.parametrize("most", [1 << 20, 4])
def test_equal_windows_of_blocks(spark, most):
    options = collocations.Options(buckets=1 << 15, windows=most)
    every = b"\xff" * (options.buckets // 8)
    texts = ["one two three, four", "One two three four five six. two three", "", None, "é two three", "two three"]
    batch = pa.record_batch([pa.array(texts), pa.array(["en", "en", "en", "fr", "fr", "en"])], names=["text", "lang"])
    rows = [r for b in collocations.task_windows(iter([batch] * 3), every, every, options) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    expected = Counter()
    for text, lang in zip(texts, ["en", "en", "en", "fr", "fr", "en"], strict=True):
        for piece in (text or "").lower().replace(",", ".").split("."):
            words = piece.split()
            expected.update((lang, *(words[i : i + 5] + [None] * 5)[:5]) for i in range(len(words)))
    got = Counter()
    for *window, n in rows:
        got[tuple(window)] += n
    assert got == {w: 3 * n for w, n in expected.items()}
    assert most == 4 or len(rows) == len(expected)
    assert list(collocations.task_windows(iter([]), every, every, options)) == []


def test_rows_of_a_query(spark):
    options = collocations.Options(buckets=1 << 15, texts=2)
    every = b"\xff" * (options.buckets // 8)
    table = spark.createDataFrame([("one two three", "en")] * 20, "text string, lang string").coalesce(1)
    windows = collocations.count_windows(table, every, every, options)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert sorted((r["w1"], r["n"]) for r in windows.collect()) == [("one", 20), ("three", 20), ("two", 20)]
        made, plans = [], [windows._jdf.queryExecution().executedPlan()]
        while plans:
            plan = plans.pop()
            if plan.nodeName() == "AdaptiveSparkPlan":
                plans.append(plan.executedPlan())
            elif "QueryStage" in plan.nodeName():
                plans.append(plan.plan())
            if plan.nodeName() == "MapInArrow":
                made.append(plan.metrics().apply("numOutputRows").value() if plan.metrics().contains("numOutputRows") else plan.metrics().apply("pythonNumRowsReceived").value())
            plans += [plan.children().apply(i) for i in range(plan.children().size())]
        assert made == [3]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
