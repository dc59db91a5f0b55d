"""SQL for DuckDB that gives the rows of the queries that SQL can express, by joins instead of sketches and cells."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def minhash(words: int, percent: int) -> str:
    """All pairs of documents with a shingle in common, then what is reachable by links."""
    return rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - {words - 1}, 1) + 1), lambda i: array_to_string(ws[i:i + {words - 1}], ' '))) AS g FROM w WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id, doc_id = m.root AS kept FROM (SELECT doc_id, min(root) AS root FROM r GROUP BY 1) m LEFT JOIN n USING (doc_id)"""


def vectors(cosine: float) -> str:
    """All pairs of vectors of a label, then what is reachable by links."""
    return f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {cosine}),
r AS (SELECT vec_id, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id)
SELECT vec_id, coalesce(n.n, 0) AS n_links, m.root AS component_id, vec_id = m.root AS kept FROM (SELECT vec_id, min(root) AS root FROM r GROUP BY 1) m LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1) n USING (vec_id)"""


def repetition(limits) -> str:
    """Words, windows and lines as rows; ``limits`` are quality_rules.Limits."""
    lengths = sorted({limits.base_window, *limits.ngram_share})
    columns = lambda n: ", ".join(["word", *(f"w{j}" for j in range(1, n))])
    windows = ",\n".join(
        f"g{n} AS MATERIALIZED (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, {columns(n)}) > 1 AS twice FROM k WHERE w{n - 1} IS NOT NULL),\n"
        f"c{n} AS MATERIALIZED (SELECT p.doc_id, count(*) AS words, sum(p.chars) AS chars FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS i FROM g{n} WHERE twice) x JOIN p USING (doc_id, i) GROUP BY 1)"
        for n in lengths
    )
    leads = ", ".join(f"lead(word, {j}) OVER q AS w{j}" for j in range(1, max(lengths)))
    shares = ", ".join(f"coalesce(c{n}.chars, 0) / greatest(word_chars, 1)::DOUBLE AS dup_{n}gram_share" for n in sorted(limits.ngram_share))
    joins = " ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in lengths)
    within = " AND ".join(f"dup_{n}gram_share <= {share}" for n, share in sorted(limits.ngram_share.items()))
    symbols = "coalesce(text, '')"
    return rf"""
WITH w AS MATERIALIZED (SELECT doc_id, text, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
p AS MATERIALIZED (SELECT doc_id, i, word, length(word) AS chars FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w)),
k AS MATERIALIZED (SELECT doc_id, i, word, {leads} FROM p WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
{windows},
t AS (SELECT doc_id, count(*) AS n_words, sum(chars)::BIGINT AS word_chars FROM p GROUP BY 1),
y AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nth FROM w),
d AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')))::BIGINT AS chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY nth) AS k FROM y WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) WHERE k > 1 GROUP BY 1),
f AS (SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, (length({symbols}) - length(regexp_replace({symbols}, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(d.n, 0) AS n_dup_lines,
  coalesce(c{limits.base_window}.words, 0) AS n_repeat_words, coalesce(d.chars, 0) / greatest(coalesce(word_chars, 0), 1)::DOUBLE AS dup_line_share, {shares} FROM w LEFT JOIN t USING (doc_id) LEFT JOIN d USING (doc_id) {joins}),
b AS (SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.base_percent} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND dup_line_share <= {limits.line_share} AND n_symbols <= {limits.symbols_per_word} * n_words AND {within} AS kept FROM b"""
