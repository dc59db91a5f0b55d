"""The base patterns and the line model in plain Python."""

import math
import re
from collections import Counter

from apotheca.llm import line_crf, personal_data

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == 0, kind == 1 and all(int(x) <= 255 for x in m.group().split(".")), kind == 2 and 12 <= len(digits) <= 19 and personal_data.luhn(digits), kind == 3 and 9 <= len(digits) <= 15)[kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def plain_score(text, model):
    """Score of a document: features of its lines, marginals by sums over the chain, their length-weighted mean."""
    text = text or ""
    lines = [x.encode() for x in text.split("\n") if x.encode().split()] or [b""]
    words = [w for x in lines for w in x.split()]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {j for i in range(len(words) - 2) if windows[words[i], words[i + 1], words[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    counts, own, at = Counter(lines), [], 0
    for line in lines:
        n, size = len(line.split()), len(line)
        here = range(at, at + n)
        share = lambda hits, of=n: sum(hits) / max(of, 1)
        own.append([
            *(share((bool(mask[c]) for c in line), size) for mask in line_crf.BYTE_CLASSES.values()),
            share(i > 0 and words[i] == words[i - 1] for i in here), share(i in inside for i in here), share(len(words[i]) == 1 for i in here),
            float(counts[line] > 1 and size > 0), math.log1p(size) / line_crf.SIZE_SCALE, math.log1p(n) / 4, (size - n + 1) / max(n, 1) / 10 * (size > 0),
        ])
        at += n
    none = [0.0] * line_crf.N_LINE
    scores = []
    for k, line in enumerate(own):
        row = [*line, *(own[k - 1] if k else none), *(own[k + 1] if k + 1 < len(own) else none), float(k == 0), float(k + 1 == len(own))]
        scores.append(sum((x - m) / s * w for x, m, s, w in zip(row, model.mean, model.scale, model.weights, strict=True)))
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    moves = model.moves
    ahead, back = [(0.0, scores[0])], [(0.0, 0.0)]
    for s in scores[1:]:
        bad, good = ahead[-1]
        ahead.append((add(bad + moves[0][0], good + moves[1][0]), add(bad + moves[0][1], good + moves[1][1]) + s))
    for s in scores[:0:-1]:
        bad, good = back[-1]
        back.append((add(moves[0][0] + bad, moves[0][1] + good + s), add(moves[1][0] + bad, moves[1][1] + good + s)))
    good = [1 / (1 + math.exp(min((a[0] + b[0]) - (a[1] + b[1]), 700))) for a, b in zip(ahead, back[::-1], strict=True)]
    sizes = [max(len(x), 1) for x in lines]
    mean = min(max(sum(g * n for g, n in zip(good, sizes, strict=True)) / sum(sizes), 1e-3), 1 - 1e-3)
    return 1 / (1 + math.exp(-(model.slope * math.log(mean / (1 - mean)) + model.offset)))
