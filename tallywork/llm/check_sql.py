"""SQL that checks the queries which SQL can express. Plain definitions: no blocks, no bisection, no grid."""

from __future__ import annotations

#: CRC-32 by its table of 256 entries; the table is made by the polynomial's rule.
_CRC_TABLE = """
crc_table AS (
    SELECT list(c ORDER BY i) AS crc_of FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) AS r(i)))"""


def _crc(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a SQL expression, in a query that joins crc_table."""
    hexed = f"hex(encode({text}))"
    octets = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: CAST('0x' || substr({hexed}, 2 * i - 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, crc_of[xor(c & 255, b) + 1])), 4294967295)"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SPELLING = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
    SELECT doc_id, run, count(*) AS times
    FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY doc_id, run),
hashed AS (SELECT run, times, {_crc("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs, crc_table),
spelt AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
near AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM holes AS a JOIN holes AS b USING (rest, i) WHERE a.word <> b.word AND length(a.word) = length(b.word)
    UNION SELECT a.word, b.word, b.n FROM holes AS a JOIN words AS b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM holes AS a JOIN words AS b ON a.rest = b.word),
best AS (
    SELECT word, count(*) AS n_near, max(near_n) AS most FROM near GROUP BY word),
formed AS (
    SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
           CASE WHEN most >= 2 * w.n THEN (SELECT min(x.near) FROM near AS x WHERE x.word = w.word AND x.near_n = b.most) END AS form,
           CASE WHEN most >= 2 * w.n THEN most END AS form_n
    FROM words AS w LEFT JOIN best AS b ON w.word = b.word),
walk AS (
    SELECT word, word AS at FROM formed
    UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON walk.at = formed.word WHERE formed.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n
FROM formed AS f JOIN walk ON f.word = walk.word JOIN formed AS l ON walk.at = l.word WHERE l.form IS NULL"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+')"

RESAMPLING = f"""
WITH {_CRC_TABLE},
doc_words AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
doc_word AS (SELECT r, unnest(w) AS word FROM doc_words),
item_word AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
bucket_of AS (SELECT word, {_crc("word")} % 10000 AS bucket FROM (SELECT word FROM doc_word UNION SELECT word FROM item_word), crc_table),
s AS (SELECT bucket, count(*) AS s FROM doc_word JOIN bucket_of USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM item_word JOIN bucket_of USING (word) GROUP BY bucket),
sums AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS all_s, coalesce((SELECT sum(t) FROM t), 0) AS all_t),
gain AS (
    SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE))
           / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS BIGINT) AS gain
    FROM s FULL JOIN t USING (bucket), sums),
weighed AS (SELECT r, count(*) AS n, sum(gain) AS weight FROM doc_word JOIN bucket_of USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (
    SELECT r, doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
           CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
    FROM doc_words LEFT JOIN weighed USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN CAST(place AS BIGINT) END AS rank
FROM scored LEFT JOIN placed USING (r)"""

LINKS = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id <= coalesce(least, vec_id) AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.a LEFT JOIN links ON vec_id = links.a"""
