"""The queries that SQL can express, in DuckDB's SQL on the same tables."""

from __future__ import annotations

LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Distinct three-word shingles of every document; all pairs that share one, counted; components by closure of the links.
JACCARD = rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS s FROM words),
    sized AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
    flat AS (SELECT doc_id, unnest(s) AS g FROM sets),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
    edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT doc_id, b FROM reach JOIN edges ON other = a)
    SELECT doc_id, n AS n_shingles, least_id AS component_id FROM sized JOIN (SELECT doc_id, min(other) AS least_id FROM reach GROUP BY 1) USING (doc_id)"""

WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def grams(words: str, k: str) -> str:
    """Every k words in a row, with the place of the first from 0."""
    return f"[struct_pack(p := i, g := array_to_string({words}[i + 1:i + {k}], ' ')) FOR i IN range(0, greatest(len({words}) - {k} + 1, 0))]"


#: The share of an item's shingles in each passage, of its question and of its answer: no index, every shingle of every document is looked up.
DECONTAMINATE = rf"""WITH parsed AS (SELECT item_id, {WORDS.format(LOWER.format("text"))} AS w, list_filter(regexp_split_to_array(regexp_replace(trim(text, E' \t\n\r\f\v'), '([.!?])\s+', E'\\1\n', 'g'), '\n+'), lambda x: trim(x, E' \t\n\r\f\v') <> '') AS sentences
        FROM benchmark WHERE text IS NOT NULL),
    items AS (SELECT row_number() OVER () AS item, item_id, w, least(5, len(w)) AS k, greatest(32, (1::BIGINT << ceil(log2(len(w)))::INT)) AS stride,
        CASE WHEN len(sentences) > 1 THEN len({WORDS.format(LOWER.format("sentences[-1]"))}) ELSE 0 END AS answer FROM parsed WHERE len(w) > 0),
    asked AS (SELECT item, item_id, k, stride, greatest(0, greatest(k, len(w) - answer) - k + 1) AS cut, unnest({grams("w", "k")}) AS x FROM items),
    wanted AS (SELECT item, item_id, k, stride, x.g AS g, bool_or(x.p < cut) AS q, bool_or(x.p >= cut) AS a FROM asked GROUP BY ALL),
    totals AS (SELECT item, count(*) AS n, count_if(q) AS nq, count_if(a) AS na FROM wanted GROUP BY 1),
    texts AS (SELECT row_number() OVER () AS row, doc_id, {WORDS.format(LOWER.format("text"))} AS w FROM documents),
    kinds AS (SELECT DISTINCT k FROM items),
    given AS (SELECT row, doc_id, len(w) AS n, k, unnest({grams("w", "k")}) AS x FROM texts, kinds),
    hits AS (SELECT row, doc_id, n AS words, item, item_id, t.k, stride, t.g, q, a, x.p AS p FROM given JOIN wanted t ON t.g = x.g AND t.k = given.k),
    placed AS (SELECT *, unnest([p // stride - 1, p // stride]) AS j FROM hits),
    passages AS (SELECT row, doc_id, item, item_id, k, j * stride AS first_word, count(DISTINCT g) AS n, count(DISTINCT g) FILTER (q) AS nq, count(DISTINCT g) FILTER (a) AS na FROM placed
        WHERE j >= 0 AND p + k <= (j + 2) * stride AND j < greatest(1, (words + stride - 1) // stride - 1) GROUP BY ALL),
    found AS (SELECT doc_id, item_id, p.n / t.n AS share, first_word, row, p.item FROM passages p JOIN totals t USING (item)
        WHERE p.n / t.n >= 0.8 AND (t.nq = 0 OR p.nq / t.nq >= 0.8) AND (t.na < k OR p.na / t.na >= 0.8))
    SELECT doc_id, item_id, share::DOUBLE AS share, first_word::BIGINT AS first_word FROM found QUALIFY row_number() OVER (PARTITION BY row, item ORDER BY share DESC, first_word) = 1"""

ORACLE_SQL = {"op7_jaccard": JACCARD, "op9_decontaminate": DECONTAMINATE}
