"""DuckDB SQL of the operators' queries, where SQL can express them: by plain definition,
without the operators' indexes and filters. The other queries are tested against plain
versions in Python."""

from __future__ import annotations

from colonnade.llm.licenses import CONTAINMENT, NOTICES, PHRASES, span

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{_UPPER}', '{_LOWER}'), '{_WORD}')"


def _place(phrase: str) -> str:
    return " AND ".join(f"words[i + {k}] = '{word}'" for k, word in enumerate(phrase.split(" "), 1))


OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS cells
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, o.vec_id AS vec_id,
    CAST(list_dot_product(q.cells, o.cells) AS BIGINT) AS score
  FROM v q JOIN v o ON q.vec_id % 20 = 0 AND o.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank
  FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_BY_PHRASE = ", ".join(
    f"list_filter(range(len(words)), lambda i: {_place(p)}) AS at_{k}" for k, p in enumerate(PHRASES)
)
_PHRASE_LABELS = ", ".join(
    f"CASE WHEN len(at_{k}) > 0 THEN '{label}' END" for k, label in enumerate(PHRASES.values())
)
_NOTICES = ", ".join(
    f"({k}, '{label}', {span(notice)}, list_distinct(string_split('{notice}', ' ')))"
    for k, (notice, label) in enumerate(NOTICES.items())
)

OP8 = f"""
WITH texts AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents
), phrases AS (
  SELECT row_id, len(words) AS n_words, {_BY_PHRASE}
  FROM (SELECT row_id, {_words('text')} AS words FROM texts)
), places AS (
  SELECT row_id, n_words, list_concat({", ".join(f"at_{k}" for k in range(len(PHRASES)))}) AS starts,
    list_filter([{_PHRASE_LABELS}], lambda x: x IS NOT NULL) AS base_list
  FROM phrases
), notices (notice, label, span, words) AS (VALUES {_NOTICES}),
placed AS (
  SELECT row_id, unnest(range(len(words))) AS place, unnest(words) AS word
  FROM (SELECT row_id, {_words('text')} AS words FROM texts)
), shared AS (
  SELECT row_id, label, wanted, count(DISTINCT word) OVER (
      PARTITION BY row_id, notice ORDER BY place RANGE BETWEEN CURRENT ROW AND span - 1 FOLLOWING
    ) AS met
  FROM placed JOIN (SELECT notice, label, span, len(words) AS wanted, unnest(words) AS word FROM notices) USING (word)
), found AS (
  SELECT row_id, list(DISTINCT label) AS labels, max(met / wanted) AS containment
  FROM shared WHERE met >= ceil({CONTAINMENT} * wanted - 1e-9) GROUP BY row_id
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base,
  list_min(starts) AS first_word, list_max(starts) AS last_word,
  array_to_string(list_sort(base_list), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base_list, coalesce(labels, [])))), ',') AS labels,
  CASE WHEN len(starts) > 0 THEN 1.0 ELSE coalesce(containment, 0.0) END AS score
FROM texts JOIN places USING (row_id) LEFT JOIN found USING (row_id)
"""

OP11 = f"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, {_words("coalesce(text, '')")} AS terms
  FROM documents
), i AS (
  SELECT row_number() OVER () AS number, item_id, {_words("coalesce(text, '')")} AS terms
  FROM benchmark
), corpus AS (
  SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0
), wanted AS (
  SELECT number, item_id, term, count(*) AS times FROM (SELECT number, item_id, unnest(terms) AS term FROM i) GROUP BY ALL
), held AS (
  SELECT row_id, doc_id, n, term, count(*) AS tf
  FROM (SELECT row_id, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM held, corpus GROUP BY term
), scores AS (
  SELECT number, item_id, row_id, doc_id,
    CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
  FROM wanted JOIN held USING (term) JOIN weights USING (term), corpus GROUP BY ALL
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY number ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLE: dict[str, str] = {"op5_top_k": OP5, "op8_licenses": OP8, "op11_lexical_search": OP11}
