"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a row of tokens: tags, and runs of words with the place they stand in (a block that is mostly links,
a plain block, or a margin such as a menu, footer or advert). Words score positive and tags negative, words of
link blocks as they turn out. One linear scan finds the contiguous region with the highest sum; its blocks, without
the margins that lie inside it, are the text. Margins cost a little where they begin and nothing beyond, so a
long advert can't cut an article in two; a run of link blocks costs at most ``Options.link_run``.

Margins are elements such as nav or aside, and those that a word of their class, id or role marks as such. A
class that only says what state something is in (has-sidebar, comments-open) marks nothing, nor does any on an element
that holds nine tenths of the words, or half of them and an h1. What such margins are is a rule and not learned, for the labels
below can't tell an advert that stands inside an article from its text.

The weights are learned from labelled pages, which are those with exactly one <article> or <main>: how much oftener a
kind of token stands inside than outside of it. That mark is a label and nothing else: it is no kind of token, and extraction
scores no page by its own. They are fitted on a bounded sample, the first ``Options.sample`` labelled pages in the order of a hash
of their id. Kinds that the sample lacks have the weight of their group (words, link words, margins, elements of prose, other tags),
which is learned from its other kinds and, on tables without labels, a prior. Without weights nothing scores, and no text is found.

Defined results: a null or empty page, or one without words outside of head, scripts and the like, gives an empty
text. Tags that are left open end where browsers end them: head at the first element that isn't metadata, p, li,
td and the like at the next of their kind, all others with the element around them; an unclosed textarea or title
hides nothing, an unclosed script or style the rest. Repeated pages are extracted each by itself, and an empty table gives an
empty result. Only the id, the html and, in the result, the columns asked for are read; one of these that is named
like the result comes back with an underscore added.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apotheca.llm import textarrays as ta
from apotheca.llm.scratch import hash_sample

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*+|[^>]*)>""", re.DOTALL)
_OPEN_COMMENT = re.compile(r"<!--.*\Z", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"\w{1,10}|[^\w\s]+")
_HINT_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Elements whose content isn't markup, and those of them that hide all that follows if left open.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
ENDLESS = frozenset("script style".split())
#: Elements whose content is never text.
HIDDEN = frozenset("head svg object audio video canvas button select datalist noscript template annotation annotation-xml".split())
METADATA = frozenset("base basefont bgsound link meta noscript script style template title head html".split())
IN_SELECT = frozenset("option optgroup hr script template".split())
VOID = frozenset("area base basefont bgsound br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block; others stand in a line.
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
#: Which open elements end when one begins; every block ends a p.
ENDS = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")),
    "tr": frozenset(("td", "th", "tr")), "tbody": frozenset(("td", "th", "tr", "thead", "tbody")), "tfoot": frozenset(("td", "th", "tr", "thead", "tbody")),
    "option": frozenset(("option",)), "optgroup": frozenset(("option", "optgroup")),
}
SOFT = frozenset(("p", "li", "dt", "dd", "td", "th", "tr", "option"))
#: Elements and words of names that mark a margin; those that divide a page; states; what has headers of its own.
MARGINS = frozenset("nav footer header aside form menu dialog search".split())
HINTS = frozenset(
    "ad ads adsbygoogle advert advertisement advertising adverts banner breadcrumb breadcrumbs comment commentform commentlist comments complementary consent contentinfo cookie cookies copyright "
    "disqus drawer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices offcanvas outbrain overlay pager pagination popup promo promoted promotion "
    "recommended related replies reply respond search share sharing shares sidebar signup skip social sponsor sponsored subscribe subscription taboola tags toc toolbar topbar widget widgets".split()
)
DIVIDING = frozenset("nav footer header menu navbar navigation masthead contentinfo topbar".split())
STATES = frozenset("has with no without is not open opened closed enabled disabled allowed on off active visible below above plus".split())
HEADED = frozenset("article post entry story page content section".split())
#: Elements that texts are made of.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 b i em strong".split())
#: What an <article> is called that isn't the page's own.
SMALL = frozenset("comment comments reply replies related recommended ad ads advert sponsored widget".split())
ARTICLE = frozenset(("article", "main"))


@dataclass(frozen=True)
class Options:
    """sample: labelled pages that are fitted on. prior: tokens that the prior weights count for. tag_cost, margin_cost: of
    the improbability of a tag in an article. beside: the most that a margin costs, a dividing one and any other.
    """

    sample: int = 4000
    prior: float = 4.0
    tag_cost: float = 0.25
    margin_cost: float = 4.0
    beside: tuple[float, float] = (24.0, 4.0)
    word_limit: float = 3.0
    link_run: float = 30.0
    least_mark: float = 0.1


#: Elements around all of a page, which tell nothing of other tags.
AROUND = frozenset("html head body".split())


@dataclass
class Element:
    """first, last: its tokens. hint: what marks it as a margin. mark: article or main, if it is one."""

    tag: str
    hint: str | None
    mark: str | None
    first: int
    last: int = -1


@dataclass
class Token:
    """A tag, or a text with its words. block: texts of one block have the same number."""

    kind: str
    words: int = 0
    text: str = ""
    block: int = 0
    link: bool = False


def _named_hint(name: str) -> str | None:
    """What a class name or id says of a margin."""
    words = [w for w in _HINT_SPLIT.split(_CAMEL.sub("-", name).lower()) if w]
    if STATES.intersection(words):
        return None
    found = [w for w in words if w in HINTS]
    if found == ["header"] and HEADED.intersection(words):
        return None
    return found[0] if found else None


def _names(tag: str, attributes: str) -> tuple[str | None, str | None]:
    """What marks an element as a margin, and whether it is an article or main itself."""
    hint = tag if tag in MARGINS else None
    mark = tag if tag in ARTICLE else None
    if "=" in attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name == "itemprop":
                mark = mark or ("article" if value.lower() == "articlebody" else None)
            elif name == "role" and value.lower() in ARTICLE:
                mark = mark or value.lower()
            elif not hint and tag not in ("body", "html"):
                hint = next(filter(None, map(_named_hint, value.split())), None)
    return hint, mark


def read_page(page: str) -> tuple[list[Token], list[Element]]:
    """The tokens of a page, and its elements that may be margins, marks or h1; linear in the page."""
    tokens: list[Token] = []
    elements: list[Element] = []
    stack: list[tuple[str, Element | None]] = []
    #: Places in the stack: of the open elements of each name, of blocks, and of those blocks that no other ends.
    where: defaultdict[str, list[int]] = defaultdict(list)
    blocks: list[int] = []
    firm: list[int] = []
    no_end: set[str] = set()
    hidden = block = 0

    def leave(at: int) -> None:
        nonlocal hidden
        tag, element = stack[at]
        if tag:
            where[tag].pop()
            hidden -= tag in HIDDEN
            stack[at] = ("", None)
        if element:
            element.last = len(tokens)

    def close(at: int) -> None:
        while len(stack) > at:
            leave(len(stack) - 1)
            stack.pop()
        for places in (blocks, firm):
            while places and places[-1] >= at:
                places.pop()

    def text(part: str) -> None:
        if part and where["head"] and hidden == 1 and not part.isspace():
            close(where["head"][-1])
        if not hidden and part:
            part = entities.unescape(part)
            tokens.append(Token("word", 0 if part.isspace() else len(_WORD.findall(part)), part, block, bool(where["a"])))

    position, last = 0, page.rfind(">")
    while True:
        match = (_TAG if position <= last else _OPEN_COMMENT).search(page, position)
        text(page[position : match.start() if match else len(page)])
        if not match:
            close(0)
            return tokens, elements
        position = match.end()
        if not match.re.groups or not match[2]:
            continue
        tag, closing = match[2].lower(), bool(match[1])
        if closing:
            if not hidden:
                block += tag in BLOCK
                tokens.append(Token(f"/{tag}", block=block))
            if where[tag]:
                at = where[tag][-1]
                if tag not in BLOCK and firm and firm[-1] > at:
                    leave(at)
                else:
                    close(at)
            continue
        if where["head"] and tag not in METADATA:
            close(where["head"][-1])
        if tag == "body":
            close(0)
        if where["select"] and tag not in IN_SELECT:
            close(where["select"][-1])
        if tag in RAW:
            end = None if tag in no_end else re.compile(rf"</{tag}[^>]*>", re.IGNORECASE).search(page, position)
            if end:
                position = end.end()
            else:
                no_end.add(tag)
                position = len(page) if tag in ENDLESS else position
            continue
        if tag in BLOCK:
            while blocks and (stack[blocks[-1]][0] == "p" or stack[blocks[-1]][0] in ENDS.get(tag, ())):
                close(blocks[-1])
            block += not hidden
        elif tag in ("a", "button") and where[tag]:
            leave(where[tag][-1])
        hint, mark = _names(tag, match[3])
        element = Element(tag, hint, mark, len(tokens), len(tokens) + 1) if (hint or mark or tag == "h1") and not hidden else None
        if element:
            elements.append(element)
        if not hidden:
            tokens.append(Token(f"margin {hint}" if hint else tag, block=block))
            if tag == "br":
                tokens.append(Token("space", text=" ", block=block))
        if tag not in VOID and (tag in BLOCK or not match[3].endswith("/")):
            if tag in BLOCK:
                blocks.append(len(stack))
                if tag not in SOFT:
                    firm.append(len(stack))
            where[tag].append(len(stack))
            stack.append((tag, element))
            hidden += tag in HIDDEN


def _covered(elements: Sequence[Element], n: int) -> list[bool]:
    """Which tokens lie in any of the elements."""
    steps = [0] * (n + 1)
    for e in elements:
        steps[e.first] += 1
        steps[e.last] -= 1
    return [d > 0 for d in accumulate(steps[:n])]


@dataclass
class Page:
    """kinds: of each token as it counts; None in a margin. marked: the label, which tokens are in the article as the page
    marks it; None if it doesn't, or if it wasn't asked for."""

    tokens: list[Token]
    kinds: list[str | None]
    marked: list[bool] | None


def analysed(page: str, options: Options, label: bool = False) -> Page:
    """What extraction sees of a page and, with ``label``, what its own mark says, for fitting."""
    tokens, elements = read_page(page)
    n = len(tokens)

    def running(out: list[bool]) -> list[int]:
        return [0, *accumulate(0 if skip else t.words for t, skip in zip(tokens, out, strict=True))]

    fixed = [e for e in elements if e.tag in MARGINS]
    outside = [e for e in elements if e.mark and not (e.tag == "article" and e.hint in SMALL)]
    in_margin = _covered([e for e in fixed if e.tag not in ("form", "header")], n)
    candidates = [e for e in outside if not in_margin[e.first]] or outside
    own = running(in_margin)
    words = lambda e, of: of[e.last] - of[e.first]
    articles: list[Element] = []
    for e in candidates if label else ():
        if e.mark == "article" and not (articles and e.first < articles[-1].last):
            articles.append(e)
    mains = [e for e in candidates if label and e.mark == "main"]
    mark = articles[0] if len(articles) == 1 else mains[0] if mains else None
    if mark and mains and mark is not mains[0] and 5 * words(mark, own) < 2 * words(mains[0], own):
        mark = mains[0]
    if mark and words(mark, own) < options.least_mark * own[n]:
        mark = None

    every = running([False] * n)
    total = words(mark, every) if mark else every[n]
    heads = [e.first for e in elements if e.tag == "h1"]
    margins = []
    for e in elements:
        if not e.hint or (mark and e.first <= mark.first and e.last >= mark.last) or (e.tag == "article" and e.hint not in SMALL):
            continue
        if e.tag == "header" and e.hint == "header" and any(a.first < e.first < a.last for a in candidates):
            continue
        share = words(e, every) / total if total else 0
        inside = not mark or mark.first < e.first < mark.last
        if inside and (share > 0.9 or share > 0.5 and any(e.first < h < e.last for h in heads)):
            continue
        margins.append(e)
    gone = _covered(margins, n)
    ends = [0, *accumulate((e.last for e in margins), max)]
    begins = {e.first for e, end in zip(margins, ends, strict=False) if e.first >= end}

    linked: Counter[int] = Counter()
    plain: Counter[int] = Counter()
    for t in tokens:
        (linked if t.link else plain)[t.block] += t.words
    kinds: list[str | None] = []
    for i, t in enumerate(tokens):
        if gone[i]:
            kinds.append(t.kind if i in begins else None)
        elif t.kind == "word":
            kinds.append("word link" if linked[t.block] > plain[t.block] else "word block")
        else:
            kinds.append(t.kind.removeprefix("margin "))
    marked = None if mark is None else [mark.first <= i < mark.last for i in range(n)]
    return Page(tokens, kinds, marked)


def prior_weight(kind: str, options: Options) -> float:
    if kind == "space":
        return 0.0
    if kind.startswith("word"):
        return 1.0 if kind == "word block" else -0.5
    if kind.startswith("margin"):
        return -6.0 if kind.removeprefix("margin ") in DIVIDING else -0.5
    return 1.0 if kind.lstrip("/") in PROSE else -1.0


def _tag_weight(kind: str, odds: float, options: Options) -> float:
    cost = math.log1p(math.exp(min(-odds, 30.0)))
    if kind.startswith("margin"):
        return -min(options.margin_cost * cost, options.beside[kind.removeprefix("margin ") not in DIVIDING])
    return -options.tag_cost * cost


def group(kind: str) -> str:
    """The group whose weight a kind has that the sample lacks."""
    if kind.startswith(("word", "space")):
        return kind
    if kind.startswith("margin"):
        return "dividing margins" if kind.removeprefix("margin ") in DIVIDING else "margins"
    return "prose" if kind.lstrip("/") in PROSE else "tags"


#: A kind of each group, for its prior.
GROUPS = {"word block": "word block", "word link": "word link", "dividing margins": "margin nav", "margins": "margin aside", "prose": "p", "tags": "div"}


def learned_weights(inside: Mapping[str, float], outside: Mapping[str, float], options: Options) -> dict[str, float]:
    """Log odds of inside against outside of kinds and groups, smoothed towards the prior; tags are held below 0."""
    within, without = Counter(inside), Counter(outside)
    for kind in {*inside, *outside}:
        if group(kind) != kind and kind.lstrip("/") not in AROUND:
            within[group(kind)] += inside.get(kind, 0)
            without[group(kind)] += outside.get(kind, 0)
    weights = {}
    for kind in {*within, *without, *GROUPS}:
        like = GROUPS.get(kind, kind)
        share = 1 / (1 + math.exp(-prior_weight(like, options)))
        odds = math.log((within[kind] + options.prior * share) / (without[kind] + options.prior * (1 - share)))
        if like.startswith("word"):
            weights[kind] = max(-options.word_limit, min(options.word_limit, odds))
        else:
            weights[kind] = 0.0 if kind == "space" else _tag_weight(like, odds, options)
    return weights


def best_region(scores: Sequence[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the highest positive sum, the first of equals; else (0, 0)."""
    best, start, end, total, begin = 0.0, 0, 0, 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, start, end = total, begin, i + 1
    return start, end


def token_scores(page: Page, weights: Mapping[str, float], options: Options) -> list[float]:
    """What each token adds; runs of links and of margins, with no other words between, cost no more than their bounds."""
    scores, run, paid = [], 0.0, 0.0
    known: dict[str, float] = {}
    for token, kind in zip(page.tokens, page.kinds, strict=True):
        if kind is None:
            scores.append(0.0)
            continue
        if kind not in known:
            known[kind] = weights.get(kind, weights.get(group(kind), 0.0))
        score = known[kind] * (token.words if token.text else 1)
        if kind == "word block" and token.words:
            run = paid = 0.0
        elif kind.startswith("margin"):
            score, paid = min(0.0, paid + score), max(paid, -score)
        elif score < 0:
            score = -min(-score, options.link_run - run)
            run -= score
        scores.append(score)
    return scores


def extract(page: str | None, weights: Mapping[str, float], options: Options) -> str:
    found = analysed(page or "", options)
    start, end = best_region(token_scores(found, weights, options))
    lines: list[list[str]] = []
    last = None
    for token, kind in zip(found.tokens[start:end], found.kinds[start:end], strict=True):
        if token.text and kind is not None:
            if token.block == last:
                lines[-1].append(token.text)
            else:
                lines.append([token.text])
            last = token.block
    return "\n".join(line for line in (" ".join("".join(x).split()) for x in lines) if line)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", options: Options | None = None) -> dict[str, float]:
    """Weights of the kinds of tokens from labelled pages; a row per kind of token goes to the driver."""
    options = options or Options()
    marks = [F.regexp_count(html_col, F.lit(rf"(?i)<{tag}[\s>]")) for tag in sorted(ARTICLE)]
    every = pages.select(id_col, html_col).filter((marks[0] == 1) | ((marks[0] == 0) & (marks[1] == 1)))
    chosen = hash_sample(every.select(id_col), id_col, options.sample).distinct()
    labelled = every.join(F.broadcast(chosen), id_col, "left_semi")
    schema = T.StructType().add("kind", T.StringType()).add("inside", T.DoubleType()).add("outside", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside, outside = Counter(), Counter()
            for page in batch.column(0).to_pylist():
                found = analysed(page or "", options, label=True)
                if found.marked is None:
                    continue
                for token, kind, own in zip(found.tokens, found.kinds, found.marked, strict=True):
                    if kind is not None and kind.lstrip("/") not in ARTICLE:
                        (inside if own else outside)[kind] += token.words if token.text else 1
            kinds = sorted({*inside, *outside})
            yield pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.string()), "inside": pa.array([float(inside[k]) for k in kinds]), "outside": pa.array([float(outside[k]) for k in kinds])})

    counts = labelled.select(html_col).mapInArrow(run, schema).groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    return learned_weights({r["kind"]: r["inside"] for r in counts}, {r["kind"]: r["outside"] for r in counts}, options)


def extract_text(pages: DataFrame, weights: Mapping[str, float], id_col: str = "page_id", html_col: str = "html", keep: Sequence[str] = (), options: Options | None = None) -> DataFrame:
    """id, the columns of ``keep``, and text of every row. One narrow pass."""
    options = options or Options()
    names = [f"{c}_" if c == "text" else c for c in (id_col, *keep)]
    schema = T.StructType([T.StructField(n, pages.schema[c].dataType) for n, c in zip(names, (id_col, *keep), strict=True)] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, found in ta.text_ranges(batch.column(0)):
                texts = pa.array([extract(page, weights, options) for page in found], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(row, end - row).columns[1:], texts], names=schema.names)

    source = pages.select(html_col, id_col, *keep)
    return source.mapInArrow(run, schema)
