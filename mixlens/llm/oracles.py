"""DuckDB SQL for the rows of the queries that SQL can express on whole tables."""

from __future__ import annotations

from mixlens.llm import op1_quality, op4_urls, op11_trie, op13_hotjoin

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')".format


def _distance(p: str, q: list[float]) -> str:
    """Jensen-Shannon distance of the list ``p`` to constants."""
    terms = [f"(CASE WHEN {p}[{k}] > 0 THEN {p}[{k}] * log2({p}[{k}] / (({p}[{k}] + {x!r}) / 2)) ELSE 0 END" + (f" + {x!r} * log2({x!r} / (({p}[{k}] + {x!r}) / 2))" if x > 0 else "") + ")" for k, x in enumerate(q, 1)]
    return f"sqrt(greatest(({' + '.join(terms)}) / 2, 0))"


def quality() -> str:
    names = op1_quality.common_words()
    word_refs, class_refs = op1_quality.references(op1_quality.WORD_REFERENCES, op1_quality.CLASS_REFERENCES)
    punctuation = op1_quality.PUNCTUATION.replace("'", "''")
    count = lambda pattern: f"len(regexp_extract_all(text, '{pattern}'))"
    common = ", ".join(f"len(list_filter(words, lambda w: lower(w) = '{w}')) / greatest(n_words, 1)" for w in names)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT rid, doc_id, text, {_WORDS("text")} AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
i AS (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w),
t AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t FROM i),
r AS (SELECT rid, t FROM t GROUP BY 1, 2 HAVING count(*) > 1),
c AS (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM t JOIN r USING (rid, t)),
n AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM c GROUP BY 1),
b AS (
  SELECT doc_id, words, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST({count("[#*$%&|<>]")} AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    {count("[a-z]")} AS c1, {count("[A-Z]")} AS c2, {count(r"\p{L}")} - {count("[A-Za-z]")} AS c3, {count("[0-9]")} AS c4, {count(punctuation)} AS c5
  FROM w LEFT JOIN n USING (rid)
),
p AS (SELECT *, list_transform([c1, c2, c3, c4, c5, word_chars - c1 - c2 - c3 - c4 - c5], lambda x: x / greatest(word_chars, 1)) AS pc, [{common}] AS pw0 FROM b),
q AS (SELECT *, list_append(pw0, 1 - list_sum(pw0)) AS pw FROM p),
s AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN least({", ".join(_distance("pc", x) for x in class_refs)}) END AS cd, CASE WHEN n_words > 0 THEN least({", ".join(_distance("pw", x) for x in word_refs)}) END AS wd FROM q
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance,
  NOT base_failed AND NOT coalesce((word_chars >= 200 AND cd > 0.20) OR (n_words >= 150 AND wd > 0.30), false) AS kept FROM s
"""


TOP_K = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
s AS (SELECT DISTINCT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

COMPONENTS = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
i AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, CASE WHEN len(words) > 0 THEN 2 ELSE 1 END))) AS i FROM w),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS s FROM i),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT k.a, k.b FROM k JOIN n x ON x.doc_id = k.a JOIN n y ON y.doc_id = k.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1) m USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality(), "op4_url_filters": op4_urls.ORACLE, "op7_exact_topk": TOP_K, "op10_jaccard_join": COMPONENTS,
        "op11_prefix_trie": op11_trie.oracle(op13_hotjoin.crc32("CAST(c AS VARCHAR)")), "op13_hot_key_join": op13_hotjoin.ORACLE,
    }
