"""Phrases, hard negatives and nearest neighbours, against SQL and brute force."""

import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from apotheca.llm import collocations, hard_negatives, nearest, queries
from apotheca.llm import textarrays as ta

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_collocations", "op12_hard_negatives"])
def test_queries_give_the_rows_of_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, FOLDER), con.sql(queries.ORACLE_SQL[name])
    assert got.columns == list(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def plain_phrases(docs, least, top):
    counts, total = Counter(), Counter()
    for text, lang in docs:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            counts.update((lang, *words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    often = {g: n for g, n in counts.items() if n >= least}
    inner = {}
    for g, n in often.items():
        for k in range(2, len(g) - 1):
            for i in range(1, len(g) - k + 1):
                part = (g[0], *g[i : i + k])
                inner[part] = max(inner.get(part, 0), n)
    rows = []
    for (lang, *words), a in often.items():
        if len(words) < 2 or inner.get((lang, *words), 0) >= a:
            continue
        cuts = [(1000 * a * total[lang] // (often[lang, *words[:k]] * often[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        rows.append((lang, " ".join(words), a, often[lang, *words[:k]], often[lang, *words[k:]], total[lang], score))
    out = []
    for lang in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(lang, n, *r[1:]) for n, r in enumerate(own[:top], 1)]
    return sorted(out)


def phrase_docs():
    rng = random.Random(1)
    words = ["the", "The", "of", "new", "york", "é", "ÉTÉ", "a", "b.", "c,d", "x\x01y", " ", "zz;"]
    docs = [("".join(rng.choice(words) + rng.choice([" ", "  ", "\t", "\n", "\r\n"]) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "de", None])) for _ in range(120)]
    return docs + [("new york new york new york", "en")] * 9 + [(None, "en"), ("", None), ("...", "fr"), (" ", "fr"), ("a a a a a a a", "fr"), ("one two " * 30000, "es"), ("q" * 200000, "es")]


@pytest.mark.parametrize(("least", "top", "buckets", "keys"), [(2, 40, 1 << 15, 1 << 23), (7, 5, 1 << 20, 500)])
def test_phrases_by_brute_force(spark, least, top, buckets, keys):
    docs = phrase_docs()
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "text string, lang string, n long, phrase string").repartition(3)
    got = collocations.mine_phrases(table, options=collocations.Options(least=least, top=top, buckets=buckets, keys=keys))
    assert sorted(map(tuple, got.collect())) == plain_phrases(docs, least, top)


def test_phrases_of_nothing(spark):
    schema = "text string, lang string"
    for rows in ([], [(None, None)], [("a b", "en")]):
        assert collocations.mine_phrases(spark.createDataFrame(rows, schema)).collect() == []


def test_pruned_windows_are_fewer_and_lose_nothing(spark):
    """Windows end where no frequent phrase can go on; counts of frequent phrases stay as they are with all windows."""
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text", "lang")
    options = collocations.Options(least=20)
    often, every = collocations.frequent_buckets(table, options), b"\xff" * (options.buckets // 8)
    pruned = collocations.count_windows(table, often, collocations.frequent_buckets(table, options, often), options)
    pairs, whole = (collocations.count_windows(table, b, every, options) for b in (often, every))
    assert pruned.count() < pairs.count() and pairs.count() * 5 < whole.count()
    both = [sorted(map(tuple, collocations.frequent_phrases(w, 20).collect())) for w in (pruned, whole)]
    assert both[0] == both[1]


def test_scores_past_64_bits(spark):
    n = 10**13
    rows = [("en", 0, "", n), ("en", 1, "a", 5 * 10**11), ("en", 1, "b", 3 * 10**11), ("en", 2, "a b", 2 * 10**11 + 7)]
    got = collocations._scored(spark.createDataFrame(rows, "lang string, size int, phrase string, n long"), collocations.Options()).first()
    assert got.score == 1000 * (2 * 10**11 + 7) * n // (5 * 10**11 * 3 * 10**11)


def plain_negatives(rows, low=30, high=90):
    """rows: (id, label, whole numbers or None)."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = set()
    for a in rows:
        if a[0] % 100:
            continue
        scored = sorted(((-dot(a[2], b[2]), b[0], b[1] == a[1]) for b in rows if b[0] != a[0] and len(a[2]) == len(b[2])))
        for s, i, _ in [x for x in scored if x[2]][:5]:
            found = [x for x in scored if not x[2] and low * -s <= 100 * -x[0] <= high * -s][:10]
            out |= {(a[0], i, k, j, -s, -t) for k, (t, j, _) in enumerate(found, 1)}
    return sorted(out)


def vector_rows(clusters, n=900, size=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, size))
    v = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, size)) * (0.05 if clusters < n else 0)
    return [(i, int(rng.integers(0, 4)), [float(np.float32(x)) for x in v[i]]) for i in range(n)]


SCHEMA = "vec_id long, label int, embedding array<float>, score double, id string"


def odd_vectors():
    same = [1.0, 0.5, 0.25, 0.125]
    rows = [(i, i % 2, same) for i in range(0, 400)] + [(400, None, same), (500, 1, None), (600, 1, [1.0, None, 1.0, 1.0]), (700, 1, [1.0, math.nan, 1.0, 1.0]), (800, 1, [1.0, math.inf, 1.0, 1.0])]
    return rows + [(900, 1, []), (1000, 1, [0.0] * 4), (1100, 0, [1.0, 2.0]), (1101, 0, [2.0, 1.0]), (1102, 1, [1.0, 1.0]), (1200, 3, [-1.0, -0.5, -0.25, -0.125]), (None, 1, same), (1300, 1, [1e30] * 4)]


@pytest.mark.parametrize("clusters", [6, 900])
def test_negatives_by_brute_force(spark, clusters):
    rows = vector_rows(clusters)
    options = hard_negatives.Options(row_block=200, anchor_block=3, codewords=5, first_run=16)
    table = spark.createDataFrame([(*r, 0.0, "x") for r in rows], SCHEMA)
    got = hard_negatives.mine_negatives(table, F.col("vec_id") % 100 == 0, options=options)
    want = plain_negatives([(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows])
    assert want and sorted(map(tuple, got.collect())) == want


def test_negatives_of_odd_rows(spark):
    table = spark.createDataFrame([(*r, 0.0, "x") for r in odd_vectors()], SCHEMA)
    got = hard_negatives.mine_negatives(table, F.col("vec_id") % 100 == 0, options=hard_negatives.Options(row_block=64))
    usable = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in odd_vectors() if i is not None and v is not None and not any(x is None or not abs(x) < 1e9 for x in v)]
    assert sorted(map(tuple, got.collect())) == plain_negatives(usable)
    assert hard_negatives.mine_negatives(table.filter("false"), F.col("vec_id") % 100 == 0).collect() == []
    twice = hard_negatives.mine_negatives(table.filter("vec_id = 1100").union(table.filter("vec_id in (1100, 1101, 1102)")), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, twice.collect())) == [(1100, 1101, 1, 1102, 4 * 65536, 3 * 65536)]


def test_cells_come_by_falling_bounds_and_searches_stop_early():
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, size=(40, 8)).astype(float)
    vectors = centres[rng.integers(0, 40, 4000)] + rng.integers(-2, 3, size=(4000, 8))
    books = tuple(hard_negatives.kmeans(vectors[:, half], 16, 10, 1) for half in (slice(0, 4), slice(4, 8)))
    index = hard_negatives.MultiIndex(vectors, books)
    ids = np.arange(4000)
    for anchor in vectors[:20]:
        cells = list(index.cells(anchor))
        assert [c[0] for c in cells] == sorted((c[0] for c in cells), reverse=True)
        assert sorted(itertools.chain.from_iterable(range(s, e) for _, s, e in cells)) == list(range(4000))
        assert all(hard_negatives.scores(index.vectors[s:e], anchor).max() <= bound for bound, s, e in cells)
        seen = []
        runs = index.runs

        def counted(a, size, runs=runs, seen=seen):
            for x in runs(a, size):
                seen.append(len(x[1]))
                yield x

        index.runs = counted
        (score, found), = hard_negatives.best_in_windows(index, anchor, ids, ids >= 0, [(-np.inf, np.inf)], 10, 64)
        index.runs = runs
        exact = vectors @ anchor
        order = np.lexsort((ids, -exact))[:10]
        assert found.tolist() == order.tolist() and score.tolist() == exact[order].tolist()
        assert sum(seen) < 2000


def plain_nearest(rows, k=10):
    rows = [(i, v) for i, _, v in rows if i is not None and v and all(x is not None and abs(x) < math.inf for x in v) and any(v)]
    out = {}
    for q, v in rows:
        if q % 100 == 0:
            scored = sorted((math.sqrt(((np.array(v) - np.array(w)) ** 2).sum()), i) for i, w in rows if i != q and len(v) == len(w))
            out[q] = [i for _, i in scored[:k]]
    return out


@pytest.mark.parametrize(("clusters", "size"), [(8, 40), (900, 40), (900, 12)])
def test_recall_of_nearest(spark, clusters, size):
    rows = vector_rows(clusters, size=size)
    got = nearest.nearest(spark.createDataFrame([(*r, 0.0, "x") for r in rows], SCHEMA), F.col("vec_id") % 100 == 0, options=nearest.Options(columns=8, row_block=100, query_block=2)).collect()
    want, vectors = plain_nearest(rows), {i: np.array(v) for i, _, v in rows}
    assert sorted((r.query_id, r.rank) for r in got) == [(q, k) for q in sorted(want) for k in range(1, 11)]
    assert sum(r.vec_id in want[r.query_id] for r in got) >= 0.95 * len(got)
    assert all(r.score == np.sqrt(((vectors[r.query_id] - vectors[r.vec_id]) ** 2).sum()) for r in got)
    for q in want:
        own = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
        assert [x[1:] for x in own] == sorted(x[1:] for x in own)


def test_nearest_of_odd_rows(spark):
    table = spark.createDataFrame([(*r, 0.0, "x") for r in odd_vectors()], SCHEMA)
    found = nearest.nearest(table, F.col("vec_id") % 100 == 0).collect()
    want = plain_nearest(odd_vectors())
    assert {(r.query_id, r.rank): r.vec_id for r in found} == {(q, k): i for q, ids in want.items() for k, i in enumerate(ids, 1)}
    assert nearest.nearest(table.filter("false"), F.col("vec_id") % 100 == 0).collect() == []


def test_rows_are_abandoned_early():
    rng = np.random.default_rng(0)
    rows, query = rng.normal(size=(5000, 64)), rng.normal(size=64)
    exact = np.sqrt(((rows - query) ** 2).sum(1))
    limit = np.sort(exact)[9]
    cut = lambda m: [m[..., s : s + 16] for s in range(0, 64, 16)]
    left = nearest.near_rows(cut(rows), cut(query), limit, 2.1)
    assert set(np.flatnonzero(exact <= limit)) <= set(left) and len(left) < 40


def test_hashes_of_bytes_follow_no_structure():
    """Words of 1024 letters and more in Thue and Morse's order collide under any polynomial modulo 2 ** 64."""
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    swapped = word.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((word + swapped).encode(), dtype=np.uint8)
    for n in (1024, 2048, 4096):
        a, b = ta.range_hashes(data, np.array([0, len(word)]), np.array([n, len(word) + n]))
        assert a != b
    rng = np.random.default_rng(0)
    data = rng.integers(0, 3, 5000).astype(np.uint8)
    starts = rng.integers(0, 4900, 4000)
    ends = starts + rng.integers(0, 100, 4000)
    found = {}
    for s, e, h in zip(starts, ends, ta.range_hashes(data, starts, ends), strict=True):
        found.setdefault(data[s:e].tobytes(), set()).add(int(h))
    assert all(len(h) == 1 for h in found.values()) and len(set().union(*found.values())) == len(found)


def test_structured_texts_are_not_copies(spark):
    """Such words, lines and documents are counted and linked as the different texts that they are."""
    import corpus_pipeline
    from apotheca.llm import minhash, quality_rules

    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    swapped = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word, "en", "s", 1024), (2, swapped, "en", "s", 1024), (3, f"{word}\n{swapped}\n{word}", "en", "s", 3074)], "doc_id long, text string, lang string, source string, n_chars long")
    groups = {r.doc_id: (r.component_id, r.kept) for r in minhash.duplicate_groups(docs, options=minhash.Options(words=4)).collect()}
    assert groups == {1: (1, True), 2: (2, True), 3: (3, True)}
    assert {r.doc_id: r.n_dup_lines for r in quality_rules.repetition_stats(docs).collect()} == {1: 0, 2: 0, 3: 1}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {1, 2, 3}


@pytest.mark.parametrize(("low", "high"), [(1, 1), (2, 12), (1, 40), (20, 40), (33, 90), (300, 600)])
def test_short_documents_are_packed_with_little_padding(low, high):
    from apotheca.llm.packing import Worker

    rng, worker = random.Random(1), Worker(2048, 0)
    lengths = [rng.randint(low, high) for _ in range(20_000)]
    placed = [x for i, n in enumerate(lengths) for x in worker.add(i, bytes(4 * n))] + worker.finish()
    held = Counter()
    for piece, sequence, offset in placed:
        assert offset == held[sequence]
        held[sequence] += piece[2]
    assert sum(held.values()) == sum(lengths)
    padding = sum(2048 - n for n in held.values() if n & (n - 1))
    assert padding < 0.05 * sum(lengths)


def test_cells_decide_at_every_size(spark):
    """k-means makes several cells of the given tables' labels, and they spare most of the pairs of clustered vectors."""
    from apotheca.llm import embedding_dedup

    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 32))
    vectors = centres[rng.integers(0, 20, 2000)] + 0.02 * rng.normal(size=(2000, 32))
    options = embedding_dedup.Options()
    centroids = embedding_dedup.spherical_kmeans(vectors, math.ceil(2000 ** (1 / 3)), options)
    row, cell, home = embedding_dedup.cells_of(vectors, centroids, options)
    at_home, visits = np.bincount(cell[home], minlength=len(centroids)), np.bincount(cell, minlength=len(centroids))
    assert len(centroids) == 13 and (at_home * visits).sum() < 0.25 * 2000**2
