"""Windows are sent by as many tasks as cores need, however many parts the input has."""

from apotheca.llm import collocations


def test_parts_of_the_input(spark, monkeypatch):
    count, made, sent = collocations.count_windows, [], []

    def counted(texts, often, triples, options):
        made.append(texts.rdd.getNumPartitions())
        schema = "lang string, w1 string, w2 string, w3 string, w4 string, w5 string, n long"
        rows = texts.mapInArrow(lambda batches: collocations.task_windows(batches, often, triples, options), schema)
        sent.append(rows.count())
        return count(texts, often, triples, options)

    monkeypatch.setattr(collocations, "count_windows", counted)
    table = spark.createDataFrame([("one two three", "en")] * 640, "text string, lang string").repartition(64)
    rows = collocations.mine_phrases(table, options=collocations.Options(buckets=1 << 15)).collect()
    assert [tuple(r) for r in rows] == [("en", 1, "one two three", 640, 640, 640, 1920, 3000)]
    most = 2 * spark.sparkContext.defaultParallelism
    assert made[0] <= most
    assert sent[0] <= 3 * most
