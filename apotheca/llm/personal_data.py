"""Personal data by candidate gradient boosting.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; their matches are always spans. Beyond
them, generators of high recall propose overlapping candidates: addresses with a spelled-out @ or dot, dotted
numbers in brackets, and of runs of digits with any separators, cut at base spans, every series of neighbouring groups
with a fitting number of digits. Boosted trees score every candidate by its format and
its context, and thresholds calibrated per kind select those that become spans too.

The trees are fitted on a bounded sample. Base matches are counted in all documents that hold a digit or an @; of
those documents, the first ``Options.sample`` in the order of a hash of their id are taken, and for each kind the
first ``Options.per_kind`` that have a match of it, however rare they are. Labels come from the text itself: base
matches and the same matches in several disguises (other separators, no country code, brackets) are positive;
candidates that aren't base matches and base matches that are broken (a wrong check digit, a part over 255, too few
digits) are negative. The fewer matches a kind has, the more disguises are made of each. ``Options.prior`` fixed made-up
texts of each kind are always learned from too, so every kind is fitted on tables of any size, and on more shapes of
names than a table may have. A third
of the matches, with all made of them, and of the other candidates is kept from the trees and sets each kind's
threshold: the least score, at even odds or better, at which the share of positives above it is at least
``Options.precision``.

Defined results: a null or empty text has no spans. Whole texts are read. Positions are code points, ends
exclusive. Matches of one kind don't overlap, those of different kinds may. Without a model nothing is added to
base matches. Rows are independent; only the id and the text are read, and ``redact_documents`` returns
the input's columns.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache, reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apotheca.llm import textarrays as ta
from apotheca.llm.boosting import Trees, fit_trees
from apotheca.llm.scratch import Table, hash_sample

KINDS = ("email", "ip", "card", "phone")
#: (start, end, index in KINDS)
Span = tuple[int, int, int]

#: The base patterns. The look-behinds only spare starts inside a run, at which no match can begin.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HAS_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[0-9]+")

_AT = re.compile(r"@|[(\[{<]\s?at\s?[)\]}>]", re.IGNORECASE)
_LOOSE_DOMAIN = re.compile(r"\s?[\w-]++(?:\s?(?:\.|[(\[{<]\s?(?:dot|\.)\s?[)\]}>])\s?[\w-]++)+", re.IGNORECASE)
_NUMBER_GAP = re.compile(r"[\x20\xa0().,/_-]{1,3}")
_LOOSE_IP = re.compile(r"(?<![0-9.])[0-9]{1,4}(?:[\[({]?\x20?\.\x20?[\])}]?[0-9]{1,4}){3,5}(?![0-9])")


@dataclass(frozen=True)
class Options:
    sample: int = 20_000
    per_kind: int = 1_000
    prior: int = 120
    #: Per document, of what is learned from.
    matches: int = 8
    others: int = 8
    precision: float = 0.98
    least_positives: int = 20
    rounds: int = 40
    seed: int = 5


@dataclass(frozen=True)
class Model:
    trees: Trees
    thresholds: tuple[float, ...]


def luhn(digits: str) -> bool:
    values = [int(d) for d in digits[::-1]]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each base pattern that pass its check, by start, then kind."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            out.append((start, done, 0))
        at = text.find("@", max(at + 1, done))
    if _HAS_DIGIT.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15]
    out.sort()
    return sorted(out, key=lambda s: (s[0], s[2]))


class Blocked:
    """Whether a span touches any of the base spans, by bisection."""

    def __init__(self, base: Sequence[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end, _ in base:
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def touches(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start


def _numbers(text: str, base: Blocked) -> Iterator[Span]:
    """Series of digit groups with a fitting number of digits; a start has at most 19 ends, so the work is linear."""
    run: list[tuple[int, int]] = []

    def series() -> Iterator[Span]:
        for i, (start, _) in enumerate(run):
            n, first = 0, start - 1 if start and text[start - 1] in "+(" and not base.touches(start - 1, start) else start
            for at, end in run[i:i + 19]:
                n += end - at
                if n > 19:
                    break
                if n >= 12:
                    yield first, end, 2
                if 7 <= n <= 15:
                    yield first, end, 3

    for m in _DIGITS.finditer(text):
        if run and (m.start() - run[-1][1] > 3 or not _NUMBER_GAP.fullmatch(text, run[-1][1], m.start()) or base.touches(run[-1][1], m.start())):
            yield from series()
            run.clear()
        if base.touches(m.start(), m.end()):
            yield from series()
            run.clear()
        else:
            run.append(m.span())
    yield from series()


def _local_start(text: str, end: int) -> int:
    """Where the run of address characters begins that ends at ``end``, or at a space before it; ``end`` if there is none."""
    at = end - 1 if end and text[end - 1].isspace() else end
    start = at
    while start and (text[start - 1].isalnum() or text[start - 1] in "_.%+-"):
        start -= 1
    return start if start < at else end


def candidates(text: str, base: Sequence[Span] = ()) -> list[Span]:
    """What the generators propose beside the base spans; candidates may overlap."""
    out: set[Span] = set()
    blocked = Blocked(base)
    for m in _AT.finditer(text):
        start, domain = _local_start(text, m.start()), _LOOSE_DOMAIN.match(text, m.end())
        if start < m.start() and domain and not blocked.touches(start, domain.end()):
            out.add((start, domain.end(), 0))
    if _HAS_DIGIT.search(text):
        out |= {(m.start(), m.end(), 1) for m in _LOOSE_IP.finditer(text) if not blocked.touches(m.start(), m.end())}
        out.update(_numbers(text, blocked))
    return sorted(out)


#: Words before a candidate that say what it is.
_CONTEXT = tuple(
    re.compile(rf"(?i)\b(?:{words})\W*\Z")
    for words in (
        "mail|email|e-mail|contact|courriel|correo|an|write to",
        "ip|host|server|address|adresse|from|addr",
        "card|visa|mastercard|amex|carte|karte|tarjeta|credit",
        "phone|tel|telephone|call|mobile|cell|fax|telefon|téléphone|teléfono|whatsapp",
        "version|v|release|isbn|no|nr|id|order|section|art|p|pp|page|ticket|token",
    )
)
#: Between a candidate and the digits next to it.
_GAP_BEFORE = re.compile(r"(?<=[0-9])([\x20\xa0().,/_-]{0,3})\Z")
_GAP_AFTER = re.compile(r"([\x20\xa0().,/_-]{0,3})(?=[0-9])")
_CHAR = {"": 0.0, " ": 0.0, "\n": 0.0}


def _char_class(c: str) -> float:
    return _CHAR[c] if c in _CHAR else 1.0 if c.isalpha() else 2.0 if c.isdigit() else 4.0 if c in "%$€£" else 3.0


def _context(text: str, start: int) -> tuple:
    before = text[max(0, start - 24) : start]
    gap = _GAP_BEFORE.search(before)
    return (gap.group(1) if gap else None, _char_class(text[start - 1 : start]), *(float(bool(c.search(before))) for c in _CONTEXT))


def features(text: str, span: Span, context: tuple | None = None) -> list[float]:
    """Format and context of a candidate; context: of its start, if it is known."""
    start, end, kind = span
    part = text[start:end]
    groups = _DIGITS.findall(part)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    letters = sum(c.isalpha() for c in part)
    others = [c for c in part if not c.isalnum()]
    left, char, *words = context or _context(text, start)
    last = re.findall(r"\w+", part)[-1:] or [""]
    gaps = re.findall(r"(?<=[0-9])[^0-9]+(?=[0-9])", part)
    right = (m := _GAP_AFTER.match(text, end, end + 4)) and m.group(1)
    return [
        *(float(kind == k) for k in range(4)),
        len(part), len(digits), len(groups), min(sizes), max(sizes), sizes[0], sizes[-1], float(len(set(sizes)) == 1),
        len(others), len(set(others)), float(part[0] == "+"), float(digits[:2] == "00"), float("(" in part), float("." in part), float("-" in part), float("/" in part or "," in part),
        float("@" in part), float("[" in part or "{" in part), float(12 <= len(digits) <= 19 and luhn(digits)), float(bool(groups) and all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        letters / len(part), len(last[0]), float(last[0].isalpha()), len(set(digits)),
        float(sizes in ([4, 2, 2], [2, 2, 4]) or sizes[:3] in ([4, 2, 2], [2, 2, 4])),
        char, _char_class(text[end : end + 1]),
        float(part.count("(") == part.count(")")), len(set(gaps)), max(map(len, gaps), default=0), float(any("," in g for g in gaps)), float(sizes[-3:] == [3, 3, 4]), float(sizes[:3] == [3, 3, 4]),
        sizes[1] if len(sizes) > 1 else 0, sizes[-2] if len(sizes) > 1 else 0, float(set(sizes[:-1]) == {4}),
        *(float(x) for g in (left, right) for x in ((-1, 0) if g is None else (len(g), g in gaps))),
        *words,
    ]


def _disguised(part: str, kind: int, rng: random.Random) -> str:
    """The same data in another spelling, which the base pattern doesn't match."""
    if kind == 0:
        local, domain = part.split("@")
        mark = rng.choice([" (at) ", "(at)", "[at]", " [at] ", " @ "])
        return local + mark + (domain.replace(".", rng.choice(["[dot]", " (dot) ", "[.]"])) if rng.random() < 0.5 else domain)
    if kind == 1:
        return part.replace(".", rng.choice(["[.]", "(.)", " . "]), rng.choice([1, 3]))
    digits = "".join(_DIGITS.findall(part))
    if kind == 2:
        mark = rng.choice([".", " - ", "/", "  "])
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    groups = [digits[-10:-7], digits[-7:-4], digits[-4:]]
    return rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "001 {} {} {}", "001-{}-{}-{}"]).format(*groups)


def _broken(part: str, kind: int, rng: random.Random) -> str:
    """Something like it that isn't personal data."""
    digits = "".join(_DIGITS.findall(part))
    if kind == 0:
        return part.split("@")[0] + rng.choice([" (at) ", " @ "]) + part.split("@")[1].replace(".", " ")
    if kind == 1:
        parts = part.split(".")
        parts[rng.randrange(4)] = str(rng.randint(256, 9999))
        return ".".join(parts if rng.random() < 0.6 else [*part.split("."), str(rng.randint(0, 99))])
    if kind == 2:
        wrong = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10)
        mark = rng.choice(["", " ", "-", ".", "/"])
        return mark.join(wrong[i : i + 4] for i in range(0, len(wrong), 4))
    return rng.choice([f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(10, 28)}.{rng.randint(10, 12)}.{rng.randint(1990, 2030)}", f"{rng.randint(1, 9)},{rng.randint(100, 999)},{rng.randint(100, 999)}", digits[-8:], f"{digits[-3:]} {digits[:3]} 0.{digits[:4]}", f"{digits[-4:]}/{digits[:4]}"])


def _neighbour(part: str, kind: int, rng: random.Random) -> str:
    """A number that may stand next to a match in a list or on a line."""
    if rng.random() < 0.4:
        return _disguised(part, kind, rng)
    return rng.choice([str(rng.randint(1990, 2030)), f"{rng.randint(10, 12)}/{rng.randint(20, 39)}", str(rng.randint(1, 999)), f"{rng.randint(10, 28)}.{rng.randint(10, 12)}.{rng.randint(1990, 2030)}"])


#: features, kind, label, group. Rows of a group are made of one match or are one candidate.
Row = tuple[list[float], int, float, int]


def training_rows(text: str, options: Options, copies: Sequence[int]) -> list[Row]:
    """Rows of the candidates of a text and of its base matches, each with so many disguises by kind, and broken."""
    rng = random.Random(f"{options.seed}:{text}")
    base = base_spans(text)
    open_ = candidates(text, base)
    rows = [(features(text, c), c[2], 0.0, rng.getrandbits(24)) for c in rng.sample(open_, min(len(open_), options.others))]
    for span in rng.sample(base, min(len(base), options.matches)):
        start, end, kind = span
        group = rng.getrandbits(24)
        rows.append((features(text, span), kind, 1.0, group))
        for _ in range(copies[kind]):
            for right, changed in ((True, _disguised(text[start:end], kind, rng)), (False, _broken(text[start:end], kind, rng))):
                before, after = text[max(0, start - 40) : start], text[end : end + 40]
                if kind > 1 and rng.random() < 0.5:
                    near = _neighbour(text[start:end], kind, rng)
                    before, after = (before + near + rng.choice([" ", ", ", " / "]), after) if rng.random() < 0.3 else (before, rng.choice([" ", ", ", " / "]) + near + after)
                around = before + changed + after
                at, to = len(before), len(before) + len(changed)
                for c in candidates(around):
                    if c[0] >= to or c[1] <= at or (c[2] != kind and (kind < 2 or c[2] < 2)):
                        continue
                    if kind < 2:
                        if not right or at <= c[0] and c[1] <= to:
                            rows.append((features(around, c), kind, float(right), group))
                    elif right and c[2] == kind and c[1] == to and around[c[0] : c[1]].lstrip("+(") == changed.lstrip("+("):
                        rows.append((features(around, c), kind, 1.0, group))
                    elif right or at <= c[0] and c[1] <= to:
                        if rng.random() < 0.5:
                            rows.append((features(around, c), c[2], 0.0, group))
    return rows


#: What made-up texts are put together from.
_NAMES = "anna.k joe mlopez info42 jean-luc p_weber sales dr.house contact lee99".split()
_HOSTS = "example.com mail.example.org uni-x.de firma.fr correo.es a.co.uk data.io".split()
_BEFORE = ["", "", "see ", "mail: ", "write to ", "call ", "tel. ", "phone: ", "host ", "server ", "IP ", "card ", "Karte: ", "the old one was ", "und dann ", "contacto "]
_AFTER = ["", "", " now", ", thanks", ".", " is ours", " oder später", "; et après", " (new)"]
_ORDINARY = ["on {y}-{m}-{d} at {h}", "{d}.{m}.{y}", "version {m}.{h}.{d}.{n}", "order {y}{n}{n}", "{h},{n},{n} people", "pp. {n}-{n}, {y}", "ISBN 978-{d}-{n}-{n}{d}-{h}", "from {y} to {y}", "{d}/{m}/{y} {h}:{d}", "met (at) noon. Then", "cost {n}.{d} $ and {n}.{d} $", "{n} {n} {n}", "{y}, {y}, {y}"]


def _made_up(kind: int, rng: random.Random) -> str:
    """A match of a base pattern."""
    digits = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    if kind == 0:
        return f"{rng.choice(_NAMES)}@{rng.choice(_HOSTS)}"
    if kind == 1:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        body = rng.choice("3456") + digits(14)
        number = next(body + c for c in "0123456789" if luhn(body + c))
        return rng.choice(["", " ", "-"]).join(number[i : i + 4] for i in range(0, 16, 4))
    return rng.choice(["+1 ({}) {}-{}", "+1 {} {} {}", "+44 {} {} {}", "+49 {}-{}-{}"]).format(digits(3), digits(3), digits(4))


@cache
def prior_texts(kind: int, size: int) -> tuple[str, ...]:
    """Fixed texts with a match of a kind each and ordinary numbers."""
    rng = random.Random(f"prior:{kind}")
    number = lambda: {"y": rng.randint(1990, 2030), "m": rng.randint(10, 12), "d": rng.randint(10, 28), "h": rng.randint(1, 9), "n": rng.randint(100, 999)}
    ordinary = lambda: rng.choice(_ORDINARY).format(**number())
    return tuple(f"{ordinary()} and so on, as said. {rng.choice(_BEFORE)}{_made_up(kind, rng)}{rng.choice(_AFTER)}" for _ in range(size))


def fit_rows(x: np.ndarray, kinds: np.ndarray, y: np.ndarray, groups: np.ndarray, options: Options) -> Model | None:
    """Trees on the rows of two thirds of the groups, thresholds from the rest; None if either class is missing."""
    test = groups % 3 == 2
    if not len(y) or min(y[~test].sum(), (1 - y[~test]).sum()) < options.least_positives:
        return None
    trees = fit_trees(x[~test], y[~test].astype(np.float64), rounds=options.rounds)
    score = trees.raw(x[test])
    thresholds = []
    for kind in range(len(KINDS)):
        own, label = score[kinds[test] == kind], y[test][kinds[test] == kind]
        order = np.argsort(-own, kind="stable")
        right = np.cumsum(label[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= options.precision)
        if label.sum() < options.least_positives or not len(good):
            thresholds.append(float("inf"))
        else:
            below = own[order[good[-1] + 1]] if good[-1] + 1 < len(order) else float("-inf")
            thresholds.append(max(0.0, float(own[order[good[-1]]] + below) / 2))
    return Model(trees, tuple(thresholds))


def count_matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and n_* (base matches by kind) of the documents that hold a digit or an @. One narrow pass."""
    names = [f"n_{k}" for k in KINDS]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, texts in ta.text_ranges(batch.column(1)):
                counts = np.array([np.bincount([k for *_, k in base_spans(t)], minlength=len(KINDS)) for t in texts], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), *(pa.array(c) for c in counts.T)], names=["id", *names])

    return rows.mapInArrow(run, schema)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: Options | None = None) -> Model | None:
    """Fit on a bounded sample of ``docs``; only features of candidates go to the driver."""
    options = options or Options()
    counted = Table(count_matches(docs, id_col, text_col), "matches")
    has = [F.col(f"n_{k}") > 0 for k in KINDS]
    total = counted.df.agg(F.count("*"), *(F.count_if(h) for h in has), *(F.sum(F.least(F.lit(options.matches), f"n_{k}")) for k in KINDS)).first()
    holders, matches = total[1 : 1 + len(KINDS)], [n or 0 for n in total[1 + len(KINDS) :]]
    copies = [max(2, min(16, 240 // max(n, 1))) for n in matches]
    drawn = [hash_sample(counted.df.select("id"), "id", options.sample, total[0])]
    drawn += [hash_sample(counted.df.filter(h).select("id"), "id", options.per_kind, n) for h, n in zip(has, holders, strict=True) if n]
    chosen = reduce(DataFrame.unionAll, drawn).distinct()
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id", "left_semi").filter(F.col("text").rlike("[0-9@]"))
    schema = T.StructType().add("rows", T.BinaryType())
    flat = lambda texts, copies: np.array([[*f, kind, label, group] for text in texts for f, kind, label, group in training_rows(text, options, copies)], dtype=np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in ta.text_ranges(batch.column(1)):
                rows = flat(texts, copies)
                if len(rows):
                    yield pa.RecordBatch.from_pydict({"rows": [rows.tobytes()]})

    width = len(features("1234567", (0, 7, 3))) + 3
    found = [np.frombuffer(r["rows"], dtype=np.float32).reshape(-1, width) for r in sample.select("id", "text").mapInArrow(run, schema).collect()]
    counted.drop()
    found += [flat(prior_texts(kind, options.prior), [3] * len(KINDS)) for kind in range(len(KINDS))]
    rows = np.concatenate(found) if found else np.empty((0, width), dtype=np.float32)
    found.clear()
    rows = rows[np.lexsort(rows.T)]
    return fit_rows(rows[:, :-3], rows[:, -3].astype(int), rows[:, -2], rows[:, -1].astype(np.int64), options)


def find_spans(texts: Sequence[str], model: Model | None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, by start, then kind."""
    base = [base_spans(t) for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    if model:
        limits = np.array(model.thresholds)
        right: list[tuple[float, int, Span]] = []
        proposed = ((i, c) for i, t in enumerate(texts) for c in candidates(t, base[i]))
        while some := list(islice(proposed, 10_000)):
            contexts = {at: _context(texts[at[0]], at[1]) for at in {(i, c[0]) for i, c in some}}
            scores = model.trees.raw(np.array([features(texts[i], c, contexts[i, c[0]]) for i, c in some], dtype=np.float32))
            right += [(-scores[j], *some[j]) for j in np.flatnonzero(scores >= limits[[c[2] for _, c in some]])]
        for _, i, c in sorted(right):
            at = bisect_left(added[i], c)
            if not (at and added[i][at - 1][1] > c[0]) and not (at < len(added[i]) and added[i][at][0] < c[1]):
                added[i].insert(at, c)
    return [(b, sorted([*b, *a], key=lambda s: (s[0], s[2]))) for b, a in zip(base, added, strict=True)]


def redacted(text: str, spans: Sequence[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, done, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done, i = end, i + 1
    return "".join(out) + text[done:]


_SPANS = T.ArrayType(T.StructType().add("kind", T.StringType()).add("start", T.LongType()).add("end", T.LongType()))


def find_personal_data(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base (spans of the base patterns), spans (all spans) of every row. One narrow pass."""
    schema = T.StructType([docs.schema[id_col], T.StructField("base", _SPANS), T.StructField("spans", _SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rows = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, e, k in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, texts in ta.text_ranges(batch.column(1)):
                found = find_spans(texts, model)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), *(pa.array([rows(f[i]) for f in found], kind) for i in (0, 1))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redact_documents(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with the spans in the text replaced; null stays null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, texts in ta.text_ranges(batch.column(at)):
                part = batch.slice(row, end - row)
                valid = part.column(at).is_valid().to_pylist()
                new = [redacted(t, spans) if ok else None for t, ok, (_, spans) in zip(texts, valid, find_spans(texts, model), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(new, part.column(at).type), *part.columns[at + 1 :]], schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
