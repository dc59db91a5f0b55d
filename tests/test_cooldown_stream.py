"""The streamed cooldown by buckets of keys."""

import random
from datetime import datetime, timedelta

from apotheca.streaming import scans


def test_cooldown_stream_calls_for_python_once_a_bucket(spark, tmp_path):
    rng, start = random.Random(5), datetime(2026, 1, 1)
    keys = [None, *range(2**60, 2**60 + 400)]
    rows = [(rng.choice(keys), start + timedelta(seconds=i + rng.choice([0, 0.000001])), i) for i in range(3000)]
    schema = "user bigint, at timestamp, n int"
    for k in range(3):
        spark.createDataFrame(rows[1000 * k : 1000 * (k + 1)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = scans.cooldown_stream(source, "user", "at", 600, "n", buckets=8).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    last, want = {}, []
    for key, at, n in rows:
        if key not in last or at - last[key] >= timedelta(seconds=600):
            last[key] = at
            want.append((str(key), at, n))
    assert sorted((str(r.user), r.at, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(want)
    # A state for each bucket and one for null keys, not one for each key.
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal == 9
