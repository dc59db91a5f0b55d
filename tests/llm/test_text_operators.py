"""Quality rules, the line model, personal data, BPE, packing and main text, against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from plain import plain_score, plain_spans

from apotheca.llm import bpe, line_crf, main_text, packing, personal_data, quality_rules, queries, units
from apotheca.llm import textarrays as ta

FOLDER = "/root/testdata/sf0.001"
EDGES = ["", None, " \n\t", "a", "a b c a b c a b c", "x\nx\n\nx \nx", "é" * 10 + " é\n" * 60, "\n", "a\n\nb", "word " * 30000]


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()] + EDGES


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, kept string, score double")


def rule_counts(text):
    text = text or ""
    words = text.encode().split()
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {j for i in range(len(words) - 2) if windows[words[i], words[i + 1], words[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            again += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in quality_rules.SYMBOLS), again, len(inside)


def test_rules(spark, texts):
    got = {r.doc_id: r for r in quality_rules.repetition_stats(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n_words, *_, inside = expected = rule_counts(text)
        assert tuple(got[i][c] for c in quality_rules.COUNTS) == expected
        assert got[i].base_failed == (n_words < 50 or 100 * inside > 50 * n_words)
        assert not (got[i].base_failed and got[i].kept)


def test_rules_keep(spark, texts):
    df = frame(spark, texts)
    kept = quality_rules.keep_documents(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_rules.repetition_stats(df).filter("kept").collect()}
    assert quality_rules.keep_documents(df.limit(0)).count() == 0


def test_blocks_do_not_matter(texts):
    column = pa.array(texts)
    whole = [list(x.per_doc(x.word_doc)) for _, _, x in ta.blocks(column)]
    small = [list(x.per_doc(x.word_doc)) for _, _, x in ta.blocks(column, 100)]
    assert list(itertools.chain(*whole)) == list(itertools.chain(*small))


def test_forward_backward():
    rng = np.random.default_rng(0)
    counts, moves = np.array([1, 4, 3]), rng.normal(size=(2, 2))
    score = rng.normal(size=counts.sum())
    ahead, back, total = line_crf.forward_backward(score, counts, moves)
    start = 0
    for k, n in enumerate(counts):
        weights = {y: np.exp(sum(score[start + i] * y[i] for i in range(n)) + sum(moves[y[i], y[i + 1]] for i in range(n - 1))) for y in itertools.product((0, 1), repeat=int(n))}
        z = sum(weights.values())
        assert np.isclose(np.log(z), total[k])
        for i in range(n):
            good = sum(w for y, w in weights.items() if y[i]) / z
            assert np.isclose(good, np.exp(ahead[start + i, 1] + back[start + i, 1] - total[k]))
        start += n


def test_classifier_on_held_out(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op1_quality_classifier(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_op1_against_plain_scores(spark):
    """Every score of the query, by features and sums over the chain in plain Python."""
    model = queries.quality_model(spark, FOLDER)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op1_quality_classifier(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        score = plain_score(texts[r.doc_id], model)
        assert abs(r.score - score) < 1e-6 and (r.predicted == int(score >= 0.7) or abs(score - 0.7) < 1e-6)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_classifier_edges(spark):
    df = frame(spark, EDGES)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, 7), (2, None)], "doc_id long, quality int")
    model = line_crf.fit(df, labels)
    assert line_crf.score_documents(df, model).count() == len(EDGES)
    none = line_crf.fit(df, labels.limit(0))
    assert {r.score for r in line_crf.score_documents(df, none).collect()} == {0.5}
    assert line_crf.keep_documents(df, none).columns == df.columns


def test_learned_lines():
    """Short documents teach with all their lines, long ones with consecutive lines, not always the first."""
    counts = np.array([3, 1, 250, 100, 777])
    doc, rng = np.repeat(np.arange(5), counts), np.random.default_rng(0)
    starts = set()
    for _ in range(20):
        kept = np.flatnonzero(line_crf.learned_lines(doc, rng.integers(1, 90, len(doc)), 5, 100))
        assert np.bincount(doc[kept]).tolist() == [3, 1, 100, 100, 100]
        own = kept[doc[kept] == 4]
        assert own[-1] - own[0] == 99
        starts.add(own[0])
    assert len(starts) > 5


def test_lines(spark):
    folder = "/root/testdata/sf0.01"
    model = queries.quality_model(spark, folder)
    good, bad = "Ereand thble reingwh thorin as innd thre the erndou thes ater and more of it.", "BUY!! NOW!! BUY!! NOW!! BUY!! NOW!! BUY!! NOW!! BUY!! NOW!! BUY!!"
    df = frame(spark, ["\n".join([good] * 3 + ["", " "] + [bad] * 6), None, ""])
    rows = sorted((r.doc_id, r.line, r.is_good) for r in line_crf.label_lines(df, model).collect())
    assert [x[:2] for x in rows] == [(0, i) for i in range(9)] + [(1, 0), (2, 0)]
    assert not any(x[2] for x in rows[4:9])


def test_classifier_does_not_learn_from_held_out(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality")
    models = [line_crf.fit(docs, x, usable=~queries.held_out()) for x in (labels, turned)]
    assert np.array_equal(models[0].weights, models[1].weights)


def test_base_spans(texts):
    rng = random.Random(3)
    parts = list("0123456789") * 2 + list("  ..--@@++()ab٣é\n") + ["a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (743) 555-3824"]
    for text in [t or "" for t in texts] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(5000)]:
        assert personal_data.base_spans(text) == plain_spans(text)


def test_personal_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = personal_data.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    extra = ["call (743) 555-3824 now", "ip 10[.]0[.]0[.]1 up", "card 4111.1111.1111.1111 ok", "on 2024-05-17 at 10", "a joe@x.com +1 234 567 8901 z", None, ""]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(extra)], "doc_id long, text string, spans int")
    spans = {r.doc_id: [(extra[r.doc_id][s.start : s.end], s.kind) for s in r.spans] for r in personal_data.find_personal_data(df, model).collect()}
    assert spans[0] == [("(743) 555-3824", "phone")] and spans[1] == [("10[.]0[.]0[.]1", "ip")] and spans[2] == [("4111.1111.1111.1111", "card")]
    assert spans[3] == spans[5] == spans[6] == []
    redacted = {r.doc_id: r.text for r in personal_data.redact_documents(df, model).collect()}
    assert redacted[4] == "a [EMAIL] [PHONE] z" and redacted[3] == extra[3] and redacted[5] is None and redacted[6] == ""
    assert personal_data.redact_documents(df, None).columns == df.columns
    for row in personal_data.find_personal_data(docs, model).filter("size(base) > 0").collect():
        assert {tuple(s) for s in row.base} <= {tuple(s) for s in row.spans}


@pytest.mark.parametrize("size", ["sf0.001", "none"])
def test_personal_data_small(spark, size):
    """Every kind is added to on tables of any size, and where matches are rare."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet") if size == "sf0.001" else frame(spark, ["nothing here", "on 2024-05-17", None, ""])
    model = personal_data.fit(docs)
    assert all(t < float("inf") for t in model.thresholds)
    texts = ["call (743) 555-3824 now", "ip 10[.]0[.]0[.]1 up", "card 4111.1111.1111.1111 ok", "write to joe (at) example.com please", "on 2024-05-17 at 10"]
    found = [[(t[s:e], personal_data.KINDS[k]) for s, e, k in spans] for t, (_, spans) in zip(texts, personal_data.find_spans(texts, model), strict=True)]
    assert found == [[("(743) 555-3824", "phone")], [("10[.]0[.]0[.]1", "ip")], [("4111.1111.1111.1111", "card")], [("joe (at) example.com", "email")], []]


def test_personal_data_rare(spark):
    """Rare matches are drawn though the plain sample misses them."""
    docs = frame(spark, [f"in {1900 + i % 100}" for i in range(400)] + [f"call +1 (743) 555-{1000 + i}" for i in range(8)])
    few = personal_data.Options(sample=5)
    assert personal_data.count_matches(docs, "doc_id", "text").filter("n_phone > 0").count() == 8
    model = personal_data.fit(docs, options=few)
    assert model.thresholds[3] < float("inf")


def test_number_candidates():
    """Every series of neighbouring groups with a fitting number of digits, between base spans."""
    rng = random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice(["12", "3456", "7", "890", " ", ", ", "-", " (", ") ", "+", "x", "   ", "    ", "1.2.3.4"]) for _ in range(rng.randint(0, 14)))
        base = personal_data.base_spans(text)
        groups, expected = [m.span() for m in re.finditer("[0-9]+", text)], set()
        for i, j in itertools.combinations_with_replacement(range(len(groups)), 2):
            gaps = [text[a[1] : b[0]] for a, b in itertools.pairwise(groups[i : j + 1])]
            start, end = groups[i][0], groups[j][1]
            touched = any(start < e and s < end for s, e, _ in base)
            if all(re.fullmatch(r"[ \xa0().,/_-]{1,3}", g) for g in gaps) and not touched:
                n = sum(b - a for a, b in groups[i : j + 1])
                prefix = start and text[start - 1] in "+(" and not any(s < start <= e for s, e, _ in base)
                expected |= {(start - bool(prefix), end, kind) for kind, low, high in ((2, 12, 19), (3, 7, 15)) if low <= n <= high}
        assert {c for c in personal_data.candidates(text, base) if c[2] > 1} == expected


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_neighbouring_numbers(spark, size):
    model = personal_data.fit(spark.read.parquet(f"/root/testdata/{size}/documents.parquet"))
    expected = {
        "ask (743) 555-3824, (134) 555-2562 today": [("(743) 555-3824", "phone"), ("(134) 555-2562", "phone")],
        "card 4111.1111.1111.1111 12/27 ok": [("4111.1111.1111.1111", "card")],
        "call (743) 555-3824 2024 or so": [("(743) 555-3824", "phone")],
        "call +1 (134) 555-2562, (743) 555-3824 now": [("+1 (134) 555-2562", "phone"), ("(743) 555-3824", "phone")],
        "call (743) 555-3824 now": [("(743) 555-3824", "phone")],
        "on 2024-05-17 at 10": [],
    }
    for text, (_, spans) in zip(expected, personal_data.find_spans(list(expected), model), strict=True):
        assert [(text[s:e], personal_data.KINDS[k]) for s, e, k in spans] == expected[text]


def planted(rng):
    """Texts with personal data in spellings that the base patterns don't match, and numbers that are none."""
    digits = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    words = lambda n: " ".join(rng.choice("the old river ran under a long bridge near our town and we saw it".split()) for _ in range(n))

    def card():
        body = "4" + digits(14)
        return next(body + c for c in "0123456789" if personal_data.luhn(body + c))

    def number(kind):
        if kind == 0:
            return f"{rng.choice(['ann', 'joe.w', 'k_lee', 'info'])}{rng.choice([' (at) ', '(at)', ' [at] '])}{rng.choice(['mail', 'uni-x'])}{rng.choice(['.', ' (dot) '])}{rng.choice(['org', 'com'])}"
        if kind == 1:
            return rng.choice(["[.]", "(.)"]).join(str(rng.randint(1, 255)) for _ in range(4))
        if kind == 2:
            n = card()
            return rng.choice([".", "/", " - "]).join(n[i : i + 4] for i in range(0, 16, 4))
        return rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(digits(3), digits(3), digits(4))

    def ordinary():
        return rng.choice([f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(10, 28)}.{rng.randint(10, 12)}.{rng.randint(1990, 2030)}", f"{rng.randint(1, 9)},{digits(3)},{digits(3)}", f"version {rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}", f"{rng.randint(1900, 1999)}, {rng.randint(2000, 2030)}", f"$ {digits(3)}.{digits(2)}", "met (at) noon. Then"])

    for i in range(400):
        kind = i % 5
        value = ordinary() if kind == 4 else number(kind)
        before, after = words(rng.randint(2, 9)) + " ", " " + words(rng.randint(2, 9))
        yield before + value + after, None if kind == 4 else (len(before), len(before) + len(value), kind)


def test_added_spans(spark):
    """What the trees add: planted data is found and ordinary numbers are left alone; on sf0.1 all that is added is right."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = personal_data.fit(docs)
    texts = list(planted(random.Random(12)))
    found = [set(spans) for _, spans in personal_data.find_spans([t for t, _ in texts], model)]
    wanted = [{span} if span else set() for _, span in texts]
    hits = sum(len(f & w) for f, w in zip(found, wanted, strict=True))
    assert hits >= 0.9 * sum(map(len, wanted)) and hits >= 0.95 * sum(map(len, found))
    rows = personal_data.find_personal_data(docs.select("doc_id", "text"), model).filter("size(spans) > size(base)").join(docs.select("doc_id", "text"), "doc_id").collect()
    added = [(kind, r.text[start:end]) for r in rows for kind, start, end in set(map(tuple, r.spans)) - set(map(tuple, r.base))]
    assert len(added) >= 5
    for kind, value in added:
        digits = re.sub("[^0-9]", "", value)
        assert (kind == "card" and 12 <= len(digits) <= 19 and personal_data.luhn(digits)) or (kind == "phone" and value[0] == "+" and 9 <= len(digits) <= 15)


def test_op2_edges(spark):
    """An empty table, repeated rows, null ids, and an address of any length."""
    long = "a" * 300 + "@" + "b" * 200 + ".com"
    df = spark.createDataFrame([(1, "mail a@b.com", 1), (1, "mail a@b.com", 1), (None, "mail a@b.com", 2), (2, long + " x", 3)], "doc_id long, text string, base int")
    rows = sorted((str(r.doc_id), [tuple(s) for s in r.spans]) for r in personal_data.find_personal_data(df, None).collect())
    assert rows == [("1", [("email", 5, 12)])] * 2 + [("2", [("email", 0, len(long))]), ("None", [("email", 5, 12)])]
    assert personal_data.candidates("x" * 300 + " (at) " + "y" * 100 + ".com")[0] == (0, 410, 0)
    empty = df.limit(0)
    model = personal_data.fit(empty)
    assert personal_data.find_personal_data(empty, model).count() == 0 and personal_data.redact_documents(empty, model).columns == df.columns


def test_op2_digests(spark):
    import hashlib

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in queries.op2_personal_data(spark, FOLDER).collect():
        spans = plain_spans(texts[r.doc_id])
        listed = ",".join(f"{personal_data.KINDS[k]}:{s}:{e}" for s, e, k in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for *_, k in spans) for i in range(4)]


@pytest.fixture(scope="module")
def reference():
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def odd_texts(texts):
    rng = random.Random(1)
    parts = list("abcdeéñ ß  \n\t\x1c\x85　'stdmlvre.,!?0129²Ⅷ½漢字🙂́-_=") + ["  ", " a", "the ", "'ll", "'re", "==="]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    return made + ["=" * 5000, " " * 3000, "ab" * 2000, "<|endoftext|>", " ", "a ", "Il l'été,ça \xc5\x93uvre3 ×÷ a“b” «c» d…"] + [t or "" for t in texts]


def test_bpe(odd_texts, reference):
    """The memory is so small that units are forgotten all the time."""
    vocabulary = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    memory = units.UnitMemory(vocabulary.encode_units, most=500)
    for row, end, data, offsets in ta.byte_ranges(pa.array(odd_texts), 4000):
        ids, ends = memory.encode(data, offsets)
        for k, text in enumerate(odd_texts[row:end]):
            own = ids[ends[k] : ends[k + 1]]
            assert own.tolist() == reference.encode_ordinary(text)
            assert vocabulary.decode(own) == text.encode()


def test_units_of_equal_hash(odd_texts, reference, monkeypatch):
    """Hashes only find the place; whatever they are, the ids are right."""
    vocabulary = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    monkeypatch.setattr(ta, "range_hashes", lambda data, starts, ends: (data[starts] % 7).astype(np.uint64) << np.uint64(60))
    memory = units.UnitMemory(vocabulary.encode_units, most=500)
    for row, end, data, offsets in ta.byte_ranges(pa.array(odd_texts[:300]), 2000):
        ids, ends = memory.encode(data, offsets)
        for k, text in enumerate(odd_texts[row:end]):
            assert ids[ends[k] : ends[k + 1]].tolist() == reference.encode_ordinary(text)


def test_op9_query(spark, reference, texts):
    import hashlib

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op9_bpe(spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = np.array(reference.encode_ordinary(docs[r.doc_id]), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
    # Nulls, repeated rows, null ids, columns named as the result's, and an empty table.
    odd = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "a <|endoftext|> b", "y"), (2, "", "z")], "doc_id long, text string, ids string")
    encoded = bpe.encode_documents(odd, ranks, pattern)
    found = sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in bpe.decode_documents(encoded, ranks, pattern).collect())
    plain = np.array(reference.encode_ordinary("a <|endoftext|> b"), dtype="<u4").tobytes()
    assert found == [("1", b"", b""), ("1", b"", b""), ("2", b"", b""), ("None", plain, b"a <|endoftext|> b")]
    assert bpe.decode_documents(bpe.encode_documents(odd.limit(0), ranks, pattern), ranks, pattern).count() == 0


def test_bpe_edits(odd_texts, reference):
    vocabulary, rng = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), random.Random(2)
    for _ in range(400):
        text = rng.choice(odd_texts[:3000])
        live = bpe.LiveEncoding(vocabulary, text)
        for _ in range(3):
            a, b = sorted(rng.randint(0, len(text)) for _ in range(2))
            new = rng.choice(odd_texts[:3000])[: rng.randint(0, 8)]
            text = text[:a] + new + text[b:]
            live.edit(a, b, new)
            text += "x y"
            live.append("x y")
            assert live.text == text and live.ids() == reference.encode_ordinary(text)


def packed_pieces(spark, texts):
    """Holds the pieces against the library's ids; the lengths of the sequences."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, start string, ids int")
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(docs.repartition(3), path).collect():
        pieces[r.doc_id].append((r.start, r.length, bytes(r.ids), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
        found = sorted(pieces[i])
        assert b"".join(p[2] for p in found) == ids and {p[3] for p in found} == {len(ids) // 4}
        assert [p[0] for p in found] == list(itertools.accumulate([0, *(p[1] for p in found)]))[:-1]
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == list(itertools.accumulate([0, *(n for _, n in parts)]))[:-1]
    assert packing.pack_documents(docs.limit(0), path).count() == 0
    return [sum(n for _, n in parts) for parts in sequences.values()]


def test_packing(spark, texts):
    totals = packed_pieces(spark, texts)
    assert max(totals) <= 2048
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in totals) < 0.02 * sum(totals)


def test_packing_odd_texts(spark, odd_texts):
    special = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b <|endoftext"]
    totals = packed_pieces(spark, [*odd_texts[:3000:4], *special, None, "", *special])
    assert max(totals) <= 2048


def test_op6_query(spark):
    """Every id of every document in exactly one piece, against the library; sequences gapless and within their length."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    ends, sequences = Counter(), defaultdict(list)
    for r in sorted(queries.op6_packing(spark, FOLDER).collect(), key=lambda r: (r.doc_id, r.start)):
        ids = expected[r.doc_id]
        assert r.start == ends[r.doc_id] and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        ends[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert ends == {k: len(ids) for k, ids in expected.items()}
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == list(itertools.accumulate([0, *(n for _, n in parts)]))[:-1] and sum(n for _, n in parts) <= 2048


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page"><header class="site-header"><h1>Site</h1><nav><a href=x>Home</a></nav></header>
<div id="cookie-notice"><p>We use cookies, please accept all of them now.</p></div><main><h1>Title &eacute;l&#233;</h1><p>First  <b>bold</b>text
 after &lt;b&gt; break</p><aside><p>Related stuff to read</p></aside><p>Second paragraph of the article with many words.<p title="a>b">Unclosed<!-- no --><form><label>Email</label><input></form><ul><li>point one</li><li>point two</li></ul></main>
<section class="comments"><h2>Comments</h2><p>I disagree with all of this, says a reader at great length here.</p></section><footer>(c) 2020 <a>Imprint</a></footer><script>var x="<p>no</p>";</script></body></html>"""
TEXT = "Title élé\nFirst boldtext after <b> break\nSecond paragraph of the article with many words.\nUnclosed\npoint one\npoint two"


def test_main_text(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    weights = main_text.fit(pages)
    options = main_text.Options()
    assert main_text.extract(PAGE, weights, options) == TEXT
    assert main_text.extract(PAGE.replace("main>", "div>"), weights, options) == TEXT
    assert [main_text.extract(x, weights, options) for x in ("<p>just text", "", None, "<script>only</script>", "<" * 2000)] == ["just text", "", "", "", "<" * 2000]
    for odd in ('<a "' * 50000, "<b>" * 50000 + "</i>" * 50000, "<p>" + "x<b>y</b>" * 50000, "<p>one two</p><!-- open <p>not this"):
        found = main_text.extract(odd, weights, options)
    assert found == "one two"
    tags = re.compile(r"<[^>]*>")
    import html

    for page in pages.collect():
        inside = re.search("<article>(.*?)</article>", page.html, re.DOTALL)[1]
        blocks = (" ".join(html.unescape(tags.sub(" ", b)).split()) for b in re.split("</?(?:p|h1)>", inside))
        assert main_text.extract(page.html, weights, options) == "\n".join(b for b in blocks if b)


def test_best_region():
    rng = random.Random(4)
    for _ in range(300):
        scores = [rng.randint(-3, 3) for _ in range(rng.randint(0, 12))]
        start, end = main_text.best_region(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
        assert sum(scores[start:end]) == max(best, 0)


def test_main_text_rare_labels(spark):
    """Weights come from labelled pages however rare they are."""
    plain = [f"<html><body><p>page {i}</p></body></html>" for i in range(300)]
    rare = [f"<html><nav>menu {i}</nav><article><p>text of page {i}</p></article></html>" for i in range(3)]
    rows = [(i, page) for i, page in enumerate(plain + rare)]
    few = main_text.Options(sample=3)
    fitted = main_text.fit(spark.createDataFrame(rows, "page_id long, html string"), options=few)
    assert fitted == main_text.fit(spark.createDataFrame(rows[-3:], "page_id long, html string"), options=few)
    assert fitted != main_text.fit(spark.createDataFrame(rows[:-3], "page_id long, html string"), options=few)
