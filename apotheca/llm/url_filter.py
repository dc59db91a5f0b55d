"""URL filters: rules indexed by their rarest literal token.

A rule is a regular expression with the literal tokens (runs of a-z and 0-9) that any URL it matches must hold.
The index files each rule under the one of its tokens that the fewest URLs have. A URL's tokens fetch the
candidate rules, and only those run. Rules without a literal token run on every URL. Rules are made in code or
read from a table of patterns (``rules_from_table``); they go to all tasks, so a table of more than
``MOST_RULES`` is refused.

List rules such as ``example.com/en/`` fit their host and all its subdomains, and paths that start with theirs;
the longest that fits decides. Where none fits, pattern rules decide: the first by name that matches, else the URL
is allowed.

A pattern is a piece of an address, anywhere in it unless anchored: ``|`` at its start or end is the address's start or
end, ``||`` the start of a host or of one of its parent domains, ``^`` one character other than letters, digits and
``_-.%``, or the end, and ``*`` any run of characters.

Defined results: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z
lower-cased; the path goes on up to ``?``, ``#`` or the end. A null URL, an empty one or one without ``://`` has an
empty host and path, fits no rule and is allowed. Repeated rows are judged each by itself, an empty table gives an empty
result; only the id and the URL are read, so other columns can't clash. URLs are never cut. Of equally long list rules
that fit, the last by name decides; of pattern rules that match, the first by name is named. Rules of a table that are null
or empty are left out, and repeated ones count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rules that a table may have.
MOST_RULES = 200_000

_TOKEN = re.compile(r"[a-z0-9]+")
_PARTS = re.compile(r"([^/?#]*)([^?#]*)")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """name: what is reported. pattern: searched in host + path. tokens: literal tokens of all its matches."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    listed: bool = False


def list_rule(rule: str, verdict: str) -> Rule:
    """A rule host/path. The last token is a literal one only if a delimiter ends it, for paths go on."""
    host, _, path = rule.partition("/")
    tokens = _TOKEN.findall(f"{host}/{path}".lower())
    if rule[-1:].isalnum():
        tokens = tokens[:-1]
    return Rule(rule, rf"\A(?:[^/]*\.)?{re.escape(rule)}", tuple(tokens), verdict, True)


def word_rule(word: str) -> Rule:
    """Blocks hosts that have a word, or several joined by a hyphen, between other characters."""
    return Rule(word, rf"\A(?:[^/]*[^a-z0-9/])?{re.escape(word)}(?![a-z0-9])[^/]*", tuple(_TOKEN.findall(word)), "block")


def path_rule(path: str) -> Rule:
    """Blocks paths that have this run of segments; it begins with /."""
    return Rule(path, rf"{re.escape(path)}(?![A-Za-z0-9])", tuple(_TOKEN.findall(path.translate(_LOWER))), "block")


def pattern_rule(pattern: str, verdict: str = "block") -> Rule:
    """A rule from a pattern (see above). A token is literal if nothing can stand next to it but what the pattern says."""
    body, start, end = pattern, "", ""
    if body.startswith("||"):
        body, start = body[2:], r"\A(?:[^/]*\.)?"
    elif body.startswith("|"):
        body, start = body[1:], r"\A"
    if body.endswith("|"):
        body, end = body[:-1], r"\Z"
    regex = "".join({"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|\Z)"}.get(c) or re.escape(c) for c in body)
    lowered = body.translate(_LOWER)
    tokens = [m.group() for m in _TOKEN.finditer(lowered) if (m.start() or start) and (m.end() < len(lowered) or end) and "*" not in (lowered[m.start() - 1 : m.start()], lowered[m.end() : m.end() + 1])]
    return Rule(pattern, start + regex + end, tuple(tokens), verdict)


def rules_from_table(table: DataFrame, rule_col: str = "rule", verdict_col: str | None = None) -> list[Rule]:
    """Pattern rules from a table of patterns; verdict_col: block or allow, else all block."""
    rows = table.select(F.col(rule_col).alias("rule"), (F.col(verdict_col) if verdict_col else F.lit("block")).alias("verdict")).filter("rule <> ''").distinct()
    found = rows.limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return [pattern_rule(r["rule"], r["verdict"]) for r in sorted(found)]


#: The listed rules.
LIST_RULES = tuple(
    list_rule(rule, verdict)
    for verdict, rule in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
)
#: Words of hosts, and paths, that the pattern rules block.
HOST_WORDS = ("spam", "adult", "xxx", "porn", "casino", "poker", "pills", "viagra", "replica", "warez", "torrent", "phishing", "malware", "escort", "payday-loan")
PATHS = ("/wp-login.php", "/xmlrpc.php", "/cgi-bin", "/phpmyadmin")
PATTERN_RULES = (*map(word_rule, HOST_WORDS), *map(path_rule, PATHS))


def host_and_path(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host, path = _PARTS.match(rest).groups()
    return host.translate(_LOWER), path


@lru_cache(maxsize=MOST_RULES)
def _compiled(pattern: str) -> re.Pattern:
    """Rules are compiled where and when they first run."""
    return re.compile(pattern)


class RuleIndex:
    """The rules, filed by their rarest token. frequency: in how many URLs a token occurs, 0 if unnamed."""

    def __init__(self, rules: Sequence[Rule], frequency: Mapping[str, int]):
        self.by_token: dict[str, list[Rule]] = {}
        self.always: list[Rule] = []
        for rule in rules:
            if rule.tokens:
                self.by_token.setdefault(min(rule.tokens, key=lambda t: (frequency.get(t, 0), t)), []).append(rule)
            else:
                self.always.append(rule)

    def candidates(self, address: str) -> list[Rule]:
        """The rules that have to run on an address."""
        return [rule for token in set(_TOKEN.findall(address.translate(_LOWER))) for rule in self.by_token.get(token, ())] + self.always

    def matches(self, host: str, path: str) -> list[Rule]:
        address = host + path
        return [rule for rule in self.candidates(address) if _compiled(rule.pattern).search(address)]

    def judge(self, host: str, path: str) -> tuple[str | None, str | None, str]:
        """The list rule that decides, the first pattern rule that matches, the verdict."""
        matched = self.matches(host, path)
        listed = max((r for r in matched if r.listed), key=lambda r: (len(r.name), r.name), default=None)
        pattern = min((r for r in matched if not r.listed), key=lambda r: r.name, default=None)
        verdict = listed.verdict if listed else pattern.verdict if pattern else "allow"
        return listed.name if listed else None, pattern.name if pattern else None, verdict


def token_frequencies(urls: DataFrame, url_col: str, rules: Sequence[Rule]) -> dict[str, int]:
    """In how many rows each token of the rules occurs; counted over all rows, at most one row per token is gathered."""
    wanted = sorted({t for rule in rules for t in rule.tokens})
    if not wanted:
        return {}
    tokens = urls.select(F.explode(F.array_distinct(F.split(F.lower(url_col), "[^a-z0-9]+"))).alias("token"))
    asked = F.broadcast(urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string"))
    return {r["token"]: r["n"] for r in tokens.join(asked, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n")).collect()}


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = LIST_RULES + PATTERN_RULES) -> DataFrame:
    """id, host, path, rule (the list rule that decides, else null), pattern, verdict of every row."""
    index = RuleIndex(rules, token_frequencies(pages, url_col, rules))
    schema = T.StructType([pages.schema[id_col]])
    for name in ("host", "path", "rule", "pattern", "verdict"):
        schema.add(name, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [host_and_path(url) for url in batch.column(1).to_pylist()]
            verdicts = [index.judge(*part) for part in parts]
            columns = [[p[0] for p in parts], [p[1] for p in parts], *([v[i] for v in verdicts] for i in range(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=schema.names)

    return pages.select(id_col, url_col).mapInArrow(run, schema)


def keep_pages(pages: DataFrame, url_col: str = "url", rules: Sequence[Rule] = LIST_RULES + PATTERN_RULES) -> DataFrame:
    """The rows of ``pages`` whose URL is allowed, with all their columns."""
    index, at = RuleIndex(rules, token_frequencies(pages, url_col, rules)), pages.columns.index(url_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([index.judge(*host_and_path(u))[2] == "allow" for u in batch.column(at).to_pylist()], pa.bool_()))

    return pages.mapInArrow(run, pages.schema)


def oracle_sql() -> str:
    """The same in SQL for DuckDB, from the same fixed values."""
    fits = [f"WHEN (host = '{r.name.partition('/')[0]}' OR ends_with(host, '.{r.name.partition('/')[0]}')) AND starts_with(path, '/{r.name.partition('/')[2]}') THEN '{r.name}'" for r in sorted(LIST_RULES, key=lambda r: (-len(r.name), r.name))]
    blocks = " ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in LIST_RULES)
    first = lambda rules, what, pattern: ", ".join(f"CASE WHEN regexp_matches({what}, '{pattern(r)}') THEN '{r}' END" for r in rules)
    words = first(HOST_WORDS, "host", lambda w: rf"(^|[^a-z0-9]){w}([^a-z0-9]|$)")
    paths = first(PATHS, "path", lambda p: p.replace(".", r"\.") + "([^A-Za-z0-9]|$)")
    return rf"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM rest),
ruled AS (SELECT page_id, host, path, CASE {' '.join(fits)} END AS rule, list_min([{words}, {paths}]) AS pattern FROM parts)
SELECT page_id, host, path, rule, pattern, CASE {blocks} WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM ruled"""
