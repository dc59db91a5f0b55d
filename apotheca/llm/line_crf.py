"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is a position of the chain and is labelled good or bad. Its emission score reads the
line's own features and those of the lines before and after it. Forward-backward gives each line's marginal
probability of being good; the length-weighted mean of these over a document, passed through a logistic
calibration, is the document's score.

Training labels are of documents, so in training each line takes its document's label. The model is fitted on
the driver on a bounded sample: at most ``FitOptions.per_class`` documents of each label in the order of a hash
of their id, and of each at most ``FitOptions.max_lines`` consecutive lines, from a place that depends on its length, so
long documents teach as much as others and the sample has at most 2 * per_class * max_lines lines. Scoring has no such
bounds and reads whole texts.

Defined results: a null or empty text, or one without words, is a chain of one empty line and gets that
line's score. Repeated documents score alike. Rows of labels with a null id or a label other than 0 and 1
are ignored, and a document with conflicting labels counts as 0. Without any usable label every score is 0.5.
Scores never read labels, ids or any column but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apotheca.llm import textarrays as ta
from apotheca.llm.scratch import hash_sample


def _class(chars: str) -> np.ndarray:
    mask = np.zeros(256, dtype=bool)
    mask[list(chars.encode())] = True
    return mask


#: Byte classes whose shares of a line are features.
BYTE_CLASSES = {
    "upper": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digit": _class("0123456789"),
    "symbol": _class("#*$%&<>=_~^\\"),
    "bang": _class("!?"),
    "bar": _class("|"),
    "stop": _class(".,;:"),
    "bracket": _class("()[]{}\"'"),
    "other": np.arange(256) >= 0x80,
}
N_LINE = len(BYTE_CLASSES) + 7
N_FEATURES = 3 * N_LINE + 2
SIZE_AT, SIZE_SCALE = len(BYTE_CLASSES) + 4, 6


@dataclass(frozen=True)
class FitOptions:
    """per_class, max_lines: bounds of the sample that is fitted on. steps, rate, ridge: the gradient ascent."""

    per_class: int = 1500
    max_lines: int = 100
    steps: int = 120
    rate: float = 0.1
    ridge: float = 0.02


@dataclass(frozen=True)
class Model:
    """weights: of the standardised features, for good against bad. moves[a, b]: of label b after label a."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    offset: float = 0.0


def empty_model() -> Model:
    return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), np.zeros((2, 2)))


def line_features(texts: ta.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, document and length in bytes of every line; a document without words has one empty line."""
    starts, ends, doc = texts.lines()
    bare = np.flatnonzero(np.bincount(doc, minlength=texts.n)[: texts.n] == 0)
    if len(bare):
        starts, ends, doc = np.concatenate([starts, texts.offsets[bare]]), np.concatenate([ends, texts.offsets[bare]]), np.concatenate([doc, bare])
        order = np.argsort(doc, kind="stable")
        starts, ends, doc = starts[order], ends[order], doc[order]
    size = ends - starts
    per_byte = 1 / np.maximum(size, 1)
    columns = []
    for mask in BYTE_CLASSES.values():
        count = texts.running(mask[texts.data])
        columns.append((count[ends] - count[starts]) * per_byte)
    words = texts.word_hashes()
    first, last = np.searchsorted(texts.word_start, starts), np.searchsorted(texts.word_start, ends)
    per_word = 1 / np.maximum(last - first, 1)
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (words[1:] == words[:-1]) & (texts.word_doc[1:] == texts.word_doc[:-1])
    at, hashes = texts.ngrams(words, 3)
    inside = ta.covered(at[ta.repeated(ta.in_document(hashes, texts.word_doc[at]))], 3, len(words))
    for mask in (same, inside, texts.word_end - texts.word_start == 1):
        count = texts.running(mask)
        columns.append((count[last] - count[first]) * per_word)
    columns.append(ta.repeated(ta.in_document(texts.range_hashes(starts, ends), doc)) & (size > 0))
    columns.append(np.log1p(size) / SIZE_SCALE)
    columns.append(np.log1p(last - first) / 4)
    columns.append((size - (last - first) + 1) * per_word / 10 * (size > 0))
    own = np.column_stack(columns).astype(np.float64)
    before, after = np.zeros_like(own), np.zeros_like(own)
    head, tail = np.ones(len(doc), dtype=bool), np.ones(len(doc), dtype=bool)
    head[1:] = tail[:-1] = doc[1:] != doc[:-1]
    before[1:] = own[:-1]
    before[head] = 0
    after[:-1] = own[1:]
    after[tail] = 0
    return np.column_stack([own, before, after, head, tail]), doc, size


def forward_backward(score: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log forward and backward messages of every line, and every chain's log partition.

    score: of label good (1) at each line, bad having 0. counts: lines of each chain, at least 1. The time steps
    are a loop; all chains that are still that long move together.
    """
    start = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    ahead, back = np.zeros((len(score), 2)), np.zeros((len(score), 2))
    alive = len(counts) - np.searchsorted(np.sort(counts), np.arange(counts.max(initial=0)), side="right")
    ahead[start, 1] = score[start]
    for t in range(1, len(alive)):
        at = start[order[: alive[t]]] + t
        past = ahead[at - 1]
        ahead[at, 0] = np.logaddexp(past[:, 0] + moves[0, 0], past[:, 1] + moves[1, 0])
        ahead[at, 1] = np.logaddexp(past[:, 0] + moves[0, 1], past[:, 1] + moves[1, 1]) + score[at]
    for t in range(len(alive) - 1, 0, -1):
        at = start[order[: alive[t]]] + t
        bad, good = back[at, 0], back[at, 1] + score[at]
        back[at - 1, 0] = np.logaddexp(moves[0, 0] + bad, moves[0, 1] + good)
        back[at - 1, 1] = np.logaddexp(moves[1, 0] + bad, moves[1, 1] + good)
    end = start + counts - 1
    return ahead, back, np.logaddexp(ahead[end, 0], ahead[end, 1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def line_marginals(features: np.ndarray, doc: np.ndarray, n: int, model: Model) -> np.ndarray:
    """Probability of being good of every line, given all lines of its document."""
    score = ((features - model.mean) / model.scale) @ model.weights
    ahead, back, _ = forward_backward(score, np.bincount(doc, minlength=n)[:n], model.moves)
    both = ahead + back
    return _sigmoid(both[:, 1] - both[:, 0])


def document_means(features: np.ndarray, doc: np.ndarray, size: np.ndarray, n: int, model: Model) -> np.ndarray:
    """Length-weighted mean of the lines' marginals of being good, for documents 0 ... n - 1."""
    good, weight = line_marginals(features, doc, n, model), np.maximum(size, 1)
    return np.bincount(doc, weights=weight * good, minlength=n) / np.bincount(doc, weights=weight, minlength=n)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def text_scores(texts: ta.Texts, model: Model) -> np.ndarray:
    return _sigmoid(model.slope * _logit(document_means(*line_features(texts), texts.n, model)) + model.offset)


def fit_chains(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, weights: np.ndarray, options: FitOptions) -> Model:
    """Gradient ascent on the likelihood of the lines' labels, then the calibration of document scores.

    counts, labels, weights: lines, label and weight in the population of each document.
    """
    doc = np.repeat(np.arange(len(counts)), counts)
    mean, scale = features.mean(0), features.std(0)
    scale[scale < 1e-6] = 1
    x, y = (features - mean) / scale, labels[doc]
    share = (1 / counts)[doc] / len(counts)
    rest = np.ones(len(doc), dtype=bool)
    rest[np.cumsum(counts) - counts] = False
    rest = np.flatnonzero(rest)
    theta = np.zeros(x.shape[1] + 4)
    mean_g, mean_g2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, options.steps + 1):
        w, moves = theta[:-4], theta[-4:].reshape(2, 2)
        score = x @ w
        ahead, back, total = forward_backward(score, counts, moves)
        good = _sigmoid((ahead + back)[:, 1] - (ahead + back)[:, 0])
        gradient = np.zeros_like(theta)
        gradient[:-4] = x.T @ ((y - good) * share)
        for a in (0, 1):
            for b in (0, 1):
                pair = np.exp(ahead[rest - 1, a] + moves[a, b] + b * score[rest] + back[rest, b] - total[doc[rest]])
                gradient[len(w) + 2 * a + b] = ((((y[rest] == b) & (y[rest - 1] == a)) - pair) * share[rest]).sum()
        gradient -= options.ridge / len(theta) * theta
        mean_g = 0.9 * mean_g + 0.1 * gradient
        mean_g2 = 0.99 * mean_g2 + 0.01 * gradient**2
        theta = theta + options.rate * (mean_g / (1 - 0.9**step)) / (np.sqrt(mean_g2 / (1 - 0.99**step)) + 1e-8)
    model = Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))
    size = np.expm1(SIZE_SCALE * features[:, SIZE_AT])
    z = _logit(document_means(features, doc, size, len(counts), model))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(slope * z + offset)
        g = np.array([(weights * (labels - p) * z).sum() - 0.1 * (slope - 1), (weights * (labels - p)).sum() - 0.1 * offset])
        v = weights * p * (1 - p)
        h = np.array([[(v * z * z).sum() + 0.1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.1]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, offset = max(slope + move[0], 0.05), offset + move[1]
    return Model(mean, scale, model.weights, model.moves, float(slope), float(offset))


def learned_lines(doc: np.ndarray, size: np.ndarray, n: int, most: int) -> np.ndarray:
    """Which lines are learned from: all of a document, or so many consecutive ones, from anywhere in it."""
    counts = np.bincount(doc, minlength=n)
    first = np.cumsum(counts) - counts
    scattered = np.bincount(doc, weights=size, minlength=n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    start = (scattered % np.maximum(counts - most + 1, 1).astype(np.uint64)).astype(np.int64)
    place = np.arange(len(doc)) - first[doc] - start[doc]
    return (place >= 0) & (place < most)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", usable: Column | None = None, options: FitOptions | None = None) -> Model:
    """Fit on labelled documents; ``usable`` says which ids of ``labels`` may be learned from.

    Two passes over ``labels`` and one over the sampled documents' texts. The sample's ids, at most
    2 * per_class rows, are broadcast; only the features of the sample's lines go to the driver.
    """
    options = options or FitOptions()
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    if usable is not None:
        known = known.filter(usable)
    known = known.groupBy(id_col).agg(F.min(label_col).cast("int").alias("__label"))
    sizes = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    parts = [hash_sample(known.filter(F.col("__label") == k), id_col, options.per_class, sizes.get(k, 0)) for k in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    wanted = docs.select(F.col(id_col), F.col(text_col).alias("__text")).join(F.broadcast(sample), id_col, "inner")
    schema = T.StructType().add("label", T.IntegerType()).add("counts", T.BinaryType()).add("lines", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, texts in ta.blocks(batch.column(1)):
                features, doc, size = line_features(texts)
                kept = learned_lines(doc, size, texts.n, options.max_lines)
                features, doc = features[kept], doc[kept]
                counts = np.bincount(doc, minlength=texts.n)
                known = np.array(batch.column(2).slice(row, end - row).to_pylist(), dtype=np.int64)
                for label in (0, 1):
                    fits = known == label
                    if fits.any():
                        yield pa.RecordBatch.from_pydict({"label": pa.array([label], pa.int32()), "counts": [counts[fits].astype(np.int32).tobytes()], "lines": [features[fits[doc]].astype(np.float32).tobytes()]})

    rows = wanted.select(id_col, "__text", "__label").mapInArrow(run, schema).collect()
    if not rows:
        return empty_model()
    rows.sort(key=lambda r: (r["label"], bytes(r["counts"]), bytes(r["lines"])))
    counts = [np.frombuffer(r["counts"], dtype=np.int32).astype(np.int64) for r in rows]
    features = np.concatenate([np.frombuffer(r["lines"], dtype=np.float32) for r in rows]).reshape(-1, N_FEATURES).astype(np.float64)
    label = np.repeat([r["label"] for r in rows], [len(c) for c in counts]).astype(np.float64)
    taken = {k: max((label == k).sum(), 1) for k in (0, 1)}
    weight = np.where(label == 1, sizes.get(1, 0) / taken[1], sizes.get(0, 0) / taken[0])
    return fit_chains(features, np.concatenate(counts), label, weight / weight.sum() * len(label), options)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1, higher: more likely good) of every row. One narrow pass, nothing is shuffled."""
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, texts in ta.blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(text_scores(texts, model))], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def label_lines(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per line with a word, or one for a text without: id, line (counted from 0 among these), good_probability, is_good."""
    schema = T.StructType([docs.schema[id_col]]).add("line", T.LongType()).add("good_probability", T.DoubleType()).add("is_good", T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, texts in ta.blocks(batch.column(1)):
                features, doc, _ = line_features(texts)
                good = line_marginals(features, doc, texts.n, model)
                line = np.arange(len(doc)) - np.searchsorted(doc, doc)
                ids = batch.column(0).slice(row, end - row).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids, pa.array(line), pa.array(good), pa.array(good >= 0.5)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_documents(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, texts in ta.blocks(batch.column(at)):
                yield batch.slice(row, end - row).filter(pa.array(text_scores(texts, model) >= threshold))

    return docs.mapInArrow(run, docs.schema)
