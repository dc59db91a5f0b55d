"""What the packers and the JVM beside them hold at once."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from apotheca.llm import packing, queries, units
from test_memory import peak_mb


def test_units_are_forgotten_in_little_more_than_what_stays():
    memory = units.UnitMemory(lambda texts, sizes: (np.arange(len(sizes), dtype=np.uint32), np.ones(len(sizes), dtype=np.int64)), most=400_000)
    words = [f"{i:07}".encode().translate(bytes.maketrans(b"0123456789", b"abcdefghij")) * 4 + b" " for i in range(150_000)]
    sizes = np.array([len(w) for w in words])
    data, offsets = np.frombuffer(b"".join(words), dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)])
    first, _ = memory.encode(data, offsets)
    assert np.array_equal(memory.encode(data, offsets)[0], first)
    assert peak_mb(memory._forget)[1] < 60
    assert memory.count >= 150_000 and np.array_equal(memory.encode(data, offsets)[0], first)


def test_few_texts_at_a_time_go_to_the_packers(spark, monkeypatch):
    def batches(docs, path):
        rows = docs.select("doc_id").mapInArrow(lambda b: (pa.RecordBatch.from_arrays([x.column(0), pa.array([x.num_rows] * x.num_rows, pa.int64())], names=["doc_id", "length"]) for x in b), "doc_id long, length long")
        return rows.select("doc_id", F.lit(0).cast("long").alias("start"), "length", F.lit(b"").alias("ids"), *(F.lit(0).cast("long").alias(c) for c in ("doc_tokens", "sequence_id", "offset")))

    monkeypatch.setattr(packing, "pack_documents", batches)
    found = queries.packed(spark.range(5000).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")))
    assert found.agg(F.max("length"), F.count("*")).first() == (1000, 5000)
