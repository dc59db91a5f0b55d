"""The batch job on small files that take every branch, and the table writers."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from apotheca.operators import catalogue, integration, stock
from apotheca.plans import etl
from apotheca.sources import store, tsv
from apotheca.streaming import scans

FILES = {
    "products": """10000001|ALPHA 500 mg, comprimé|comprimé|orale|Autorisation active|Nat|Commercialisée|01/01/2000|||LAB A|Non
10000002|MOLECULINE GEN 500 mg, comprimé|comprimé|orale;rectale|Autorisation active|Nat|Commercialisée|01/01/2005|||LAB B|Oui
10000003|BETA solution|solution|orale|Autorisation abrogée|Nat|Non commercialisée|01/01/1999|||LAB A|Non
10000004|GRANULE X 5CH, granules|granules|orale|Autorisation active|Enr|Commercialisée|01/01/2001|||BOIRON|Non
10000005|ORPHAN ALPHA 1 g, gélule|gélule|orale|Autorisation active|Nat|Commercialisée|01/01/2010|||LAB C|Non
10000006|LONE 10 mg, sirop|sirop|orale|Autorisation active|Nat|Commercialisée|01/01/2010|||LAB C
10000007|NOPROFILE 1 mg, gel|gel|cutanée|Autorisation active|Nat|Commercialisée|01/01/2010||||Non
123|short id|gel|x|x|x|x|x|||x|x
too|short""",
    "members": """1|MOLECULINE 500 mg - ALPHA 500 mg, comprimé|10000001|0|1
1|MOLECULINE 500 mg - ALPHA 500 mg, comprimé|10000002|1|2
2|MOLECULINE 1 g - ALPHA FORTE 1 g, comprimé|10000003|0|1
2|MOLECULINE 1 g - ALPHA FORTE 1 g, comprimé|10000002|1|2
3|GHOSTINE - GHOST, gélule|99999999|0|1""",
    "composition": """10000001|comprimé|0045|CHLORHYDRATE DE MOLECULINE|500 mg|un comprimé|SA|1
10000001|comprimé|0046|MOLECULINE|450 mg|un comprimé|FT|1
10000002|comprimé|0046|MOLECULINE (CHLORHYDRATE DE)|500 mg|un comprimé|SA|0
10000005|gélule|0046|MOLECULINE|1 g|une gélule|SA|0
10000006|sirop|0099|SOLITARINE|10 mg|5 ml|SA|0""",
    "packages": """10000001|1234567|box|a|b|c|3400912345678|oui|65%|24,34|||
10000001|1234567|box|a|b|c|3400912345678|oui|65%|abc|||""",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("raw")
    for name, text in FILES.items():
        (path / f"{name}.tsv").write_text(text.replace("|", "\t") + "\n\n")
    return str(path)


@pytest.fixture(scope="module")
def built(spark, folder):
    return etl.run(spark, folder, f"{folder}/out")


def test_clusters(built):
    rows = {r.chemical_id: r for r in built.clusters.collect()}
    assert set(rows) == {"0046", "0099"}
    assert (rows["0046"].display_name, rows["0046"].naming_method, rows["0046"].count_products) == ("ALPHA", "LCS_CONSENSUS", 4)
    assert rows["0046"].search_vector == "ALPHA ALPHA 500 MG ALPHA FORTE 1 G"
    assert (rows["0099"].display_name, rows["0099"].count_products, rows["0099"].search_vector) == ("LONE", 1, "LONE") and rows["0099"].cluster_id.startswith("ORPH_")
    members = {(r.cluster_id, r.cis, r.role) for r in built.cluster_members.collect()}
    large, alone = rows["0046"].cluster_id, rows["0099"].cluster_id
    assert members == {(large, "10000001", "GROUPED"), (large, "10000002", "GROUPED"), (large, "10000003", "GROUPED"), (large, "10000005", "ATTACHED"), (alone, "10000006", "PROMOTED")}
    assert built.cluster_brands.count() == 0


def test_brands_of_a_hot_cluster(spark):
    """Two thirds of all names are of one cluster; brands are families by first word, named by what their names share."""
    rows = [("hot" if i % 3 else f"c{i % 7}", (i // 10, 0, i, str(i)), f"{word} {'B' if word == 'AX' else i % 4} {i % 5} mg") for i, word in enumerate(["AX", "Do", "X"] * 200)]
    df = spark.createDataFrame([*rows, ("one", (0, 0, 0, "0"), "Nom seul "), ("one", (1, 0, 0, "0"), None)], "cluster_id string, pos struct<g int, o int, p int, c string>, name string")
    found = {(r.cluster_id, r.brand): tuple(r.pos) for r in integration.consolidate(df.filter("name is not null")).collect()}
    assert {b for c, b in found if c == "hot"} == {"Do 1 1 mg", "X 2 2 mg"} and found["hot", "X 2 2 mg"] == (0, 0, 2, "2")
    assert found["one", "Nom seul "] == (0, 0, 0, "0") and {b for c, b in found if c == "c0"} == {"AX B"}


def test_elections(built):
    rows = {r.group_id: (r.winner_cis, r.winner_name, r.method) for r in built.elections.collect()}
    assert rows == {"1": ("10000001", "ALPHA 500 MG", "ACTIVE_PRINCEPS"), "2": (None, "ALPHA FORTE 1 G", "LABEL_FALLBACK"), "3": (None, "GHOST", "LABEL_FALLBACK")}


def test_orphans(built):
    assert {r.cis: r.fate for r in built.placed.collect()} == {"10000005": "ATTACHED", "10000006": "PROMOTED", "10000007": "NO_PROFILE"}


def test_rejects(spark, folder):
    products, _, packages, _ = etl.read(spark, folder)
    assert tuple(products.counts().first()) == (7, 1) and tuple(packages.counts().first()) == (1, 1)


def test_gate(spark, folder):
    with pytest.raises(ValueError, match="homeopathic_rate"):
        etl.run(spark, folder, f"{folder}/not", {"homeopathic_rate": 0.01})


def test_charsets_and_arity(spark, tmp_path):
    (tmp_path / "l.tsv").write_bytes("é\tb\n\nx\ty\tz\n".encode("latin-1"))
    found = tsv.records(tsv.lines(spark, str(tmp_path / "l.tsv"), "ISO-8859-1"), ["a", "b"], raw=True)
    assert [(r.a, r.b) for r in found.rows.collect()] == [("é", "b")] and found.rejects.count() == 1
    with gzip.open(tmp_path / "g.tsv.gz", "wt") as out:
        out.write("1\t2\n")
    assert tsv.records(tsv.lines(spark, str(tmp_path / "g.tsv.gz")), ["a", "b"]).rows.count() == 1


def test_schema_report(spark, built):
    rows = {(r.column_name, r.app_type) for r in store.schema_report({"placed": built.placed}).collect()}
    assert {("cis", "String"), ("is_homeopathic", "bool"), ("pos", "int")} <= rows
    assert "specialites" in store.missing_tables({})
    odd = spark.createDataFrame([(1, None), (None, None)], "`a.b` int, `c``d` string")
    assert {r.column_name: r.filled for r in store.schema_report({"odd": odd}).collect()} == {"a.b": 1, "c`d": 0}


def test_counts_go_on_without_a_table(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "specialites.parquet"))
    spark.range(0).write.parquet(str(tmp_path / "medicaments.parquet"))
    (tmp_path / "laboratories.parquet").mkdir()
    tables = store.opened(spark, str(tmp_path), ["specialites", "medicaments", "laboratories", "none"])
    found = {r.table_name: (r.n, r.state) for r in store.check_integrity(tables).collect()}
    assert found == {"specialites": (3, "ready"), "medicaments": (0, "empty"), "laboratories": (None, "missing"), "none": (None, "missing")}
    assert "specialites" not in store.missing_tables(tables) and "laboratories" in store.missing_tables(tables)
    assert store.row_counts({"none": None}).collect() == [("none", None)]


def test_positions_follow_files(spark, tmp_path):
    """A small file before a large one of many splits, blank lines between; the same positions however files are cut."""
    expected, at = {}, 0
    for name, n in (("a.tsv", 3), ("b.tsv", 900), ("c.tsv", 0), ("d.tsv", 40)):
        rows = ["" if i % 7 == 3 else f"{name}\t{i}" for i in range(n)]
        (tmp_path / name).write_text("".join(r + "\n" for r in rows))
        expected |= {at + i: r for i, r in enumerate(rows) if r}
        at += n
    settings = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(s) for s in settings]
    try:
        for size, cost in (("300", "0"), ("1777", "10"), ("128m", "4m")):
            for setting, to in zip(settings, (size, cost), strict=True):
                spark.conf.set(setting, to)
            assert {r.pos: r.value for r in tsv.lines(spark, str(tmp_path)).collect()} == expected
            latin = sorted(tsv.lines(spark, str(tmp_path), "ISO-8859-1").collect())
            assert [r.value for r in latin] == list(expected.values())
    finally:
        for setting, to in zip(settings, before, strict=True):
            spark.conf.set(setting, to)


def test_refresh_and_json(spark, tmp_path):
    df = spark.range(3)
    store.refresh(df, str(tmp_path / "t"))
    store.refresh(df.limit(1), str(tmp_path / "t"))
    store.write_json(df, str(tmp_path / "j"))
    assert store.current(spark, str(tmp_path / "t")).count() == 1 and spark.read.json(str(tmp_path / "j")).count() == 3


def test_refresh_is_seen_whole(spark, tmp_path):
    """A version that isn't committed is not read; old versions go, the last but one stays."""
    place = str(tmp_path / "v")
    with pytest.raises(ValueError, match="no version"):
        store.current(spark, place)
    assert [store.refresh(spark.range(n), place) for n in (3, 5, 7)] == [1, 2, 3]
    spark.range(99).write.parquet(f"{place}/rows-unfinished")
    assert store.current(spark, place).count() == 7
    assert sorted(p.name for p in (tmp_path / "v" / "versions").iterdir() if p.name.isdigit()) == ["000000000002", "000000000003"]


def test_ranks_within_groups(spark):
    """Groups of any size, one of which has most rows, against a plain sort."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(40)}", rng.randrange(50), i) for i in range(3000)]
    got = {r.i: r.rank for r in catalogue.ranked(spark.createDataFrame(rows, "g string, x int, i int"), ["x", "i"], within=["g"]).collect()}
    expected = {}
    for g in {r[0] for r in rows}:
        expected |= {i: k + 1 for k, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]))}
    assert got == expected


def test_supersets_and_contained_duplicates(spark):
    rng = random.Random(4)
    sets = lambda n, name: [(f"{name}{i}", rng.sample("abcde", rng.randint(0, 4))) for i in range(n)]
    targets, candidates = sets(30, "t"), sets(60, "c")
    df = lambda rows: spark.createDataFrame(rows, "id string, elements array<string>")
    got = {(r.target_id, r.candidate_id, r.candidate_size) for r in catalogue.supersets(df(targets), df(candidates)).collect()}
    assert got == {(t, c, len(y)) for t, x in targets for c, y in candidates if x and set(x) < set(y)}
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    scans = [(i, rng.choice("kl"), rng.choice([None, "", word(rng.randint(1, 4))])) for i in range(200)]
    boxes = [(rng.choice("kl"), rng.choice([None, word(rng.randint(0, 6))])) for _ in range(6)]
    found = catalogue.contained_duplicates(spark.createDataFrame(scans, "i int, k string, s string"), spark.createDataFrame(boxes, "k string, l string"), "k", "s", "l")
    assert {r.i for r in found.collect()} == {i for i, k, s in scans if s is not None and any(b == k and x is not None and s in x for b, x in boxes)}


def test_global_rank_is_exact(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"))
    assert all(r.x + 1 == r.rank for r in catalogue.ranked(df, ["x"]).collect())


def test_quantity_fold(spark):
    rows = [("a", 1, 2), ("a", 2, -1), ("a", 3, -1), ("a", 4, 5), ("b", 1, -1)]
    df = spark.createDataFrame(rows, "k string, t int, d int")
    assert {tuple(r) for r in stock.fold_quantity(df, "k", "d", ["t"]).collect()} == {("a", 5, 1), ("b", 0, 1)}
    assert {tuple(r) for r in stock.fold_quantity(df, "k", "d", ["t"], allow_zero=True).collect()} == {("a", 5, 0), ("b", 0, 1)}


@pytest.mark.parametrize("allow_zero", [False, True])
def test_quantity_fold_hot_key(spark, allow_zero):
    """A key with most of the changes is folded in many chunks, as one after the other; no array holds a key's changes."""
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), i, rng.choice([-3, -1, -1, 0, 1, 2, 2, None])) for i in range(4000)]
    state = {}
    for key, _, change in rows:
        quantity, deletions = state.get(key, (0, 0))
        if change is not None:
            quantity += change
            gone = quantity < 0 if allow_zero else quantity <= 0
            state[key] = (0, deletions + 1) if gone else (quantity, deletions)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        found = stock.fold_quantity(spark.createDataFrame(rows, "k string, t int, d int").repartition(5), "k", "d", ["t"], allow_zero)
        assert {r.k: (r.quantity, r.deletions) for r in found.collect()} == state
        assert "collect_list" not in found._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_cooldown_forced(spark):
    rows = [("k", i, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate((0, 1, 2, 3, 4))]
    df = spark.createDataFrame(rows, "k string, i int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    found = scans.cooldown(df, "k", "t", 2, "i").orderBy("i").collect()
    assert [r.accepted for r in found] == [True, False, True, False, True]
    forced = scans.cooldown(df, "k", "t", 2, "i", forced=F.col("i") == 1).orderBy("i").collect()
    assert [r.accepted for r in forced] == [True, True, False, True, False]


@pytest.mark.parametrize("span", [2, 60, 100_000])
def test_cooldown_hot_key(spark, span):
    """A hot key's run is decided in many segments, as one scan after the other; no array holds the run."""
    rng = random.Random(span)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), i, rng.randint(0, 3000) if rng.random() < 0.99 else None, rng.random() < 0.02) for i in range(3000)]
    last, expected = {}, {}
    for key, i, t, forced in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
        expected[i] = forced or t is None or last.get(key) is None or t - last[key] >= span
        if expected[i]:
            last[key] = t
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "41")
    try:
        df = spark.createDataFrame(rows, "k string, i int, s int, f boolean").withColumn("t", F.timestamp_seconds("s")).repartition(5)
        found = scans.cooldown(df, "k", "t", span, "i", forced=F.col("f"))
        assert found.columns == [*df.columns, "accepted"]
        assert {r.i: r.accepted for r in found.collect()} == expected
        assert "collect_list" not in found._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_debounce_hot_key(spark, chunk):
    """A key with most of the changes is cut into chunks; no window is by key."""
    rng = random.Random(chunk)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), i, rng.randint(0, 4000) if rng.random() < 0.98 else None, f"v{i}") for i in range(1500)]
    expected, following = set(), {}
    for key, i, t, value in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[1]), reverse=True):
        if key not in following or t is None or following[key] - t >= 5:
            expected.add((key, value))
        following[key] = t
    df = spark.createDataFrame(rows, "k string, i int, s int, v string").withColumn("t", F.timestamp_seconds("s")).repartition(5)
    found = scans.debounce(df, "k", "t", "v", 5000, "i", chunk)
    assert {(r.k, r.v) for r in found.collect()} == expected and found.columns == ["k", "t", "v", "i"]


def test_duplicates_of_hot_null_and_tied_boxes(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.choice([None, 1, 1, 2, 3])) for _ in range(900)]
    found = stock.mark_duplicates(spark.createDataFrame(rows, "box string, t int").repartition(5), ["box"], ["t"])
    added = [(r.box, r.t) for r in found.collect() if r.outcome == "added"]
    assert sorted(added, key=str) == [("a", None), ("hot", None), (None, None)] and found.count() == len(rows)
    assert "Window" not in found._jdf.queryExecution().toString()


def test_window_streams_plan(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", "x"), ("a", "2024-01-01 00:00:00", "x"), ("a", "2024-01-01 00:10:00", "y")]
    df = spark.createDataFrame(rows, "k string, t string, v string").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    scans.run_stream(scans.unique_boxes_stream(stream, ["k", "v"], "t", "1 minute"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    scans.run_stream(scans.debounce_stream(stream, "k", "t", "v", "1 minute", "1 second"), str(tmp_path / "out2"), str(tmp_path / "state2"))
    assert {r.v for r in spark.read.parquet(str(tmp_path / "out2")).collect()} <= {"x", "y"}
