"""White space at both ends goes by a scan of the ends; no pattern runs over the text."""

from pyspark.sql import functions as F

from apotheca.functions import text


def test_trim_is_what_the_pattern_gives(spark):
    white = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    texts = [None, "", " ", " a  b", *(f"{c}a{c} b{c}{c}" for c in white), *white]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.trim("t").alias("got"), F.regexp_replace("t", rf"^[{text.WHITE}]+|[{text.WHITE}]+$", "").alias("expected"))
    assert rows.filter(~F.col("got").eqNullSafe(F.col("expected"))).count() == 0


def test_trim_runs_no_pattern(spark):
    plan = spark.range(1).select(text.trim(F.col("id").cast("string")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "trim" in plan
