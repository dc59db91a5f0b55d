"""Near-duplicates, vectors, components, URL filters, shards and the pipeline, against brute force."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from plain import plain_spans
from pyspark.sql import functions as F

import corpus_pipeline
from apotheca.llm import components, embedding_dedup, line_crf, minhash, personal_data, quality_rules, queries, sharding, url_filter
from apotheca.llm.scratch import shared_folder

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Groups:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def top(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = sorted((self.top(a), self.top(b)))
        self.up[b] = a


def test_components(spark):
    rng = random.Random(0)
    for n, m in ((30, 20), (60, 80), (40, 0)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 100 + m)]
        groups = Groups(range(300))
        for a, b in links:
            groups.link(a, b)
        table = components.components(spark.createDataFrame([*links, (None, 1)], "a long, b long"), "a", "b")
        assert {r.node: r.root for r in table.df.collect()} == {i: groups.top(i) for i in range(300) if groups.top(i) != i}
        table.drop()


def shingles(text, words):
    found = (text or "").translate(LOWER).encode().split()
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1)) or frozenset([tuple(found)])


def near_groups(texts, words):
    sets = {i: shingles(t, words) for i, t in texts.items()}
    groups = Groups(texts)
    for a, b in itertools.combinations(texts, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            groups.link(a, b)
    return {i: (len(sets[i]), groups.top(i), groups.top(i) == i) for i in texts}


def copies():
    """Exact and near copies in families with more and less in common, short texts, and edges."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = ["", None, " ", "one", "one", "ONE", "one two", "a b c d", "A b c  d", "a b c d e"]
    for family in range(6):
        base = [word() for _ in range(60 + 20 * family)]
        for _ in range(14):
            changed = list(base)
            for _ in range(rng.randint(0, 1 + family)):
                changed[rng.randrange(len(changed))] = word()
            texts.append(" ".join(changed))
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("options", [minhash.Options(words=4), minhash.Options(words=4, block=5, block_bytes=3000), minhash.Options()])
def test_minhash(spark, options):
    texts = copies()
    df = spark.createDataFrame([(i, t, True, 0) for i, t in texts.items()], "doc_id long, text string, kept boolean, id int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.duplicate_groups(df, options=options).collect()}
    assert got == near_groups(texts, options.words)
    kept = minhash.keep_one_of_each(df, options=options)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, (*_, k) in got.items() if k}


def test_minhash_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r.component_id, r.kept) for r in minhash.duplicate_groups(df).collect())
    assert rows == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert minhash.duplicate_groups(df.limit(0)).count() == 0


def test_op7(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op7_minhash(spark, FOLDER).collect()} == near_groups(texts, 4)


@pytest.mark.parametrize("options", [embedding_dedup.Options(), embedding_dedup.Options(cell=6, block=5)])
def test_vectors(spark, options):
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for label in (0, 1):
        for base in rng.normal(size=(8, 6)):
            for _ in range(6):
                rows.append((i, (base + rng.normal(size=6) * 0.25).tolist(), label))
                i += 1
    rows += [(i + k, v, label) for k, (v, label) in enumerate([(rows[0][1], 0), (rows[0][1], 1), (rows[0][1], None), (None, 0), ([], 0), ([0.0] * 6, 0), ([float("nan")] + [1.0] * 5, 0), ([float("inf")] + [1.0] * 5, 0), ([None] + [1.0] * 5, 0), ([1.0, 0.0], 0), ([2.0, 0.0], 0)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    groups, links = Groups(r[0] for r in rows), defaultdict(int)
    usable = [(i, np.array(v, dtype=float), x) for i, v, x in rows if v and x is not None and all(e is not None and np.isfinite(e) for e in v) and any(v)]
    for (a, x, la), (b, y, lb) in itertools.combinations(usable, 2):
        if la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
            groups.link(a, b)
            links[a] += 1
            links[b] += 1
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.vector_groups(df, options=options).collect()}
    assert got == {i: (links[i], groups.top(i), groups.top(i) == i) for i, *_ in rows}
    assert embedding_dedup.keep_one_of_each(df, options=options).columns == df.columns
    assert embedding_dedup.vector_groups(df.limit(0), options=options).count() == 0


def test_vector_edges(spark):
    """Repeated rows, an id on several vectors, a vector that most rows have, and columns named as the result's."""
    one, two = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, one, 0), (1, one, 0), (2, one, 0), (3, two, 0), (3, one, 0), (4, two, 0)] + [(10 + i, [1.0, 1.0], 0) for i in range(3000)]
    df = spark.createDataFrame([(*r, 7, True) for r in rows], "vec_id long, embedding array<double>, label int, n_links int, kept boolean")
    got = sorted((r.vec_id, r.component_id) for r in embedding_dedup.vector_groups(df).collect())
    assert got[:6] == [(1, 1), (1, 1), (2, 1), (3, 1), (3, 3), (4, 3)]
    assert got[6:] == [(10 + i, 10) for i in range(3000)]
    assert {r.n_links for r in embedding_dedup.vector_groups(df).filter("vec_id >= 10").collect()} == {2999}


def test_urls(spark):
    rng = random.Random(6)
    parts = ["com", "net", "org", "example", ".", "/", "en", "de", "es", "7", "8", "spam", "-", "?", "#", "://", "pills", "/wp-login.php", "X", "xxx", "://a.example.com/en/7", "é"]
    urls = [None, "", "abc"] + ["http://" * rng.randint(0, 1) + "".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(2000)]
    con = duckdb.connect()
    con.sql("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate(urls)))
    expected = {r[0]: tuple(r[1:]) for r in con.sql(url_filter.oracle_sql()).fetchall()}
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r[0]: tuple(r)[1:] for r in url_filter.judge_urls(df).collect()} == expected
    assert {r.page_id for r in url_filter.keep_pages(df).collect()} == {i for i, v in expected.items() if v[-1] == "allow"}
    every = url_filter.RuleIndex([url_filter.Rule(r.name, r.pattern, (), r.verdict, r.listed) for r in url_filter.LIST_RULES + url_filter.PATTERN_RULES], {})
    indexed = url_filter.RuleIndex(url_filter.LIST_RULES + url_filter.PATTERN_RULES, url_filter.token_frequencies(df, "url", url_filter.LIST_RULES))
    for url in urls:
        assert every.judge(*url_filter.host_and_path(url)) == indexed.judge(*url_filter.host_and_path(url))


def test_url_rules_from_a_table(spark):
    """Thousands of patterns: the index gives what all rules give, and few of them run on a URL."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4)))
    made = [rng.choice(["||{}.{}^", "/{}/{}/", "|{}.{}/*", "-{}-{}.", "{}*{}", "/{}^*^{}|", "||{}{}^*.js|"]).format(word(), word()) for _ in range(4000)]
    table = spark.createDataFrame([(p, rng.choice(["block", "allow"]), 1) for p in [*made, made[0], None, ""]], "rule string, verdict string, token int")
    rules = url_filter.rules_from_table(table, verdict_col="verdict")
    assert {r.name for r in rules} == set(made)
    urls = [f"https://{word()}.{word()}{rng.choice(['.', ''])}{word()}/{word()}/{rng.choice(['', '-', '_'])}{word()}/{word()}{rng.choice(['', '.js', '?x', '/'])}" for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    index, every = url_filter.RuleIndex(rules, url_filter.token_frequencies(df, "url", rules)), url_filter.RuleIndex([url_filter.Rule(r.name, r.pattern, (), r.verdict) for r in rules], {})
    got = {r.page_id: (r.pattern, r.verdict) for r in url_filter.judge_urls(df, rules=rules).collect()}
    matched = 0
    for i, url in enumerate(urls):
        parts = url_filter.host_and_path(url)
        assert every.judge(*parts)[1:] == got[i]
        matched += got[i][0] is not None
    assert matched > 20
    unfiled = len(index.always)
    assert np.mean([len(index.candidates("".join(url_filter.host_and_path(u)))) - unfiled for u in urls]) < 0.02 * len(rules)


def test_url_patterns():
    fits = lambda pattern, url: bool(url_filter.RuleIndex([url_filter.pattern_rule(pattern)], {}).matches(*url_filter.host_and_path(url)))
    assert fits("||ads.com^", "http://x.ads.com/1") and fits("||ads.com^", "http://ads.com") and not fits("||ads.com^", "http://bads.com/") and not fits("||ads.com^", "http://ads.com.de/")
    assert fits("/banner/*.gif|", "http://a/banner/1/x.gif") and not fits("/banner/*.gif|", "http://a/banner/x.gif2") and fits("|a.de/x", "http://a.de/xy") and not fits("|a.de/x", "http://b.a.de/x")


def test_url_edges(spark):
    """An empty table, repeated rows, null ids, and columns named as the result's."""
    df = spark.createDataFrame([(1, "http://a.com/en/1", "x", "y"), (1, "http://a.com/en/1", "x", "y"), (None, "HTTP://A.COM/en/", "x", None), (2, None, None, "z")], "page_id long, url string, host string, verdict string")
    rows = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df).collect())
    assert rows == [("1", "a.com", "/en/1", "com/en/", "block")] * 2 + [("2", "", "", None, "allow"), ("None", "a.com", "/en/", "com/en/", "block")]
    assert url_filter.judge_urls(df.limit(0)).count() == 0 and url_filter.keep_pages(df).columns == df.columns and url_filter.keep_pages(df.limit(0)).count() == 0


def test_shards(spark):
    store = sharding.ShardStore(spark, f"{shared_folder(spark)}/shards-test", target_bytes=1 << 16, fanout=3)
    rows = lambda a, b: spark.range(a, b).select("id", F.concat(F.lit("é"), F.col("id").cast("string")).alias("a `b`".replace("`", "")), F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("__x"))
    first = store.append(rows(0, 0))
    assert (first.version, first.shards, store.read().count()) == (1, (), 0)
    for k in range(7):
        store.append(rows(100 * k, 100 * k + 100), arrival=F.col("__x"))
    before = store.manifest()
    after = store.compact()
    assert after.version > before.version and len(after.shards) < len(before.shards)
    assert sorted(tuple(r) for r in store.read().collect()) == sorted(tuple(r) for r in rows(0, 700).collect())
    assert store.read(3).count() == 200
    assert sum(s.rows for s in after.shards) == 700 and all(len(v) < 3 for v in store.tiers(after).values())
    with pytest.raises(sharding.CommitConflict):
        store.commit(before, before.schema, [])
    with pytest.raises(ValueError, match="schema"):
        store.append(spark.range(1))
    assert store.vacuum() > 0 and store.read().count() == 700
    assert store.latest() == after.version and {r.shard for r in store.read(shard_col="shard").collect()} == {s.path for s in after.shards}


def test_op8(spark):
    rows = queries.op8_sharding(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert sorted(tuple(r) for r in rows.select("doc_id", "text_md5", "n_chars").collect()) == sorted(tuple(r) for r in docs.select("doc_id", F.md5("text"), "n_chars").collect())


def kept_by_rules(text):
    """The quality rules in plain Python."""
    words, limits = text.encode().split(), quality_rules.Limits()
    sizes = [len(w.decode()) for w in words]
    chars = max(sum(sizes), 1)

    def inside(n):
        windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        counts = Counter(windows)
        return {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + n)}

    seen, repeated = set(), 0
    for line in text.split("\n"):
        if line in seen:
            repeated += sum(len(w.decode()) for w in line.encode().split())
        seen.add(line)
    shares = [sum(sizes[j] for j in inside(n)) / chars <= limit for n, limit in limits.ngram_share.items()]
    symbols = sum(text.count(c) for c in quality_rules.SYMBOLS)
    base = len(words) >= 50 and 100 * len(inside(3)) <= 50 * len(words)
    return base and all(shares) and repeated / chars <= limits.line_share and symbols <= limits.symbols_per_word * len(words)


def pieces_of(spark, folder, docs):
    """What the pipeline makes of documents: rules, copies and tokens in plain Python, the two learned models as fitted."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = {i: t for i, t in docs.items() if kept_by_rules(t or "")}
    scores = {r.doc_id: r.score for r in line_crf.score_documents(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), queries.quality_model(spark, folder)).collect()} if docs else {}
    docs = {i: t for i, t in docs.items() if scores[i] >= 0.7}
    docs = {i: docs[i] for i, (*_, k) in near_groups(docs, 5).items() if k}
    model, clean = personal_data.fit(spark.createDataFrame(list(docs.items()), "doc_id long, text string")), {}
    for i, text in docs.items():
        marks = [None] * len(text)
        for start, end, kind in personal_data.find_spans([text], model)[0][1]:
            marks[start:end] = [m if m is not None else (start, kind) for m in marks[start:end]]
        assert all(marks[k] is not None for start, end, _ in plain_spans(text) for k in range(start, end))
        out = []
        for k, c in enumerate(text):
            if marks[k] is None:
                out.append(c)
            elif k == 0 or marks[k - 1] is None or (marks[k] != marks[k - 1] and marks[k][0] == k):
                out.append(f"[{personal_data.KINDS[marks[k][1]].upper()}]")
        clean[i] = "".join(out)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4") for i, t in clean.items()}


def hold_pieces(rows, expected):
    ends = Counter()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = expected[r.doc_id]
        assert r.start == ends[r.doc_id] and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        ends[r.doc_id] += r.length
    assert ends == {i: len(ids) for i, ids in expected.items()}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_pipeline(spark, size):
    folder = f"/root/testdata/{size}"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    hold_pieces(corpus_pipeline.run(spark, folder).collect(), pieces_of(spark, folder, docs))


def test_pipeline_edges(spark):
    """From end to end on an empty table, and with null and empty texts, repeated rows and columns named as the operators'."""
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    odd = docs.unionByName(docs.limit(20)).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(-1).cast("long"))).unionByName(docs.limit(1).withColumn("text", F.lit("")).withColumn("doc_id", F.lit(-2).cast("long")))
    odd = odd.withColumn("score", F.lit("x")).withColumn("kept", F.lit(False)).withColumn("component_id", F.lit(None).cast("long")).withColumn("spans", F.lit(3)).withColumn("key", F.lit(1))
    for name, table in (("empty", docs.limit(0)), ("odd", odd)):
        folder = f"{shared_folder(spark)}/pipeline-{name}"
        table.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        labels.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert len(rows) > 100 if name == "odd" else not rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, folder).columns == table.columns


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).dtypes == docs.dtypes
