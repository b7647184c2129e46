"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The table of the cyclic redundancy check: a number a byte.
_TABLE = """tbl AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"""


def _crc32(byte_list: str, begin: str = "4294967295") -> str:
    """The check of a list of bytes before its last inversion, from that of what stands before them."""
    return f"list_reduce(list_prepend({begin}, {byte_list}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))"


#: Bytes of a text of ASCII and Latin-1 letters in UTF-8.
_BYTES = "flatten(list_transform(string_split({}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x)::BIGINT - 64] END))"

SPELLING = f"""WITH RECURSIVE {_TABLE},
w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM w WHERE len(run) >= 5 GROUP BY ALL),
h AS (SELECT run, n, xor(4294967295, {_crc32(_BYTES.format("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))}) AS h FROM d, tbl),
v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, n FROM h),
c AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE len(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
del AS (SELECT word, unnest(list_distinct(list_transform(range(len(word)), lambda i: substr(word, 1, i) || substr(word, i + 2)))) AS k FROM c),
rep AS (SELECT word, unnest(list_transform(range(len(word)), lambda i: substr(word, 1, i) || '*' || substr(word, i + 2))) AS k FROM c),
p AS (SELECT del.word AS a, c.word AS b FROM del JOIN c ON k = c.word UNION ALL SELECT c.word, del.word FROM del JOIN c ON k = c.word UNION ALL SELECT x.word, y.word FROM rep x JOIN rep y ON x.k = y.k AND x.word <> y.word),
g AS (SELECT a AS word, count(*) AS n_near, min((-c.n, b)) AS best FROM p JOIN c ON c.word = b GROUP BY 1),
f AS (SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * c.n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * c.n THEN -best[1] END AS form_n FROM c LEFT JOIN g ON g.word = c.word),
r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word JOIN f e ON e.word = r.root AND e.form IS NULL"""

#: Bytes of any text in UTF-8.
_ANY_BYTES = """flatten(list_transform(string_split({}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] WHEN ord(x) < 2048 THEN [192 + (ord(x)::BIGINT >> 6), 128 + (ord(x)::BIGINT & 63)]
WHEN ord(x) < 65536 THEN [224 + (ord(x)::BIGINT >> 12), 128 + ((ord(x)::BIGINT >> 6) & 63), 128 + (ord(x)::BIGINT & 63)] ELSE [240 + (ord(x)::BIGINT >> 18), 128 + ((ord(x)::BIGINT >> 12) & 63), 128 + ((ord(x)::BIGINT >> 6) & 63), 128 + (ord(x)::BIGINT & 63)] END))"""
_RUNS = "regexp_extract_all(translate(coalesce(text, ''), '{}', '{}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')".format(_UPPER, _LOWER)

IMPORTANCE = f"""WITH {_TABLE},
w AS (SELECT true AS own, doc_id AS id, {_RUNS} AS ws FROM documents UNION ALL SELECT false, item_id, {_RUNS} FROM benchmark),
f AS (SELECT own, id, unnest(list_concat(ws, list_transform(range(len(ws) - 1), lambda i: ws[i + 1] || ' ' || ws[i + 2]), list_transform(range(len(ws) - 2), lambda i: ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]))) AS feature FROM w),
c AS (SELECT own, id, feature, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT feature, xor(4294967295, {_crc32(_ANY_BYTES.format("feature"))}) % 10000 AS bucket FROM (SELECT DISTINCT feature FROM c), tbl),
m AS (SELECT own, id, bucket, sum(n) AS n FROM c JOIN x USING (feature) GROUP BY ALL),
s AS (SELECT b.bucket, coalesce(sum(n) FILTER (WHERE own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE NOT own), 0)::DOUBLE AS t FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN m ON m.bucket = b.bucket GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * ((SELECT sum(t) FROM s) + 10000))))::BIGINT AS gain FROM s),
d AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM m JOIN g USING (bucket) WHERE own GROUP BY 1),
r AS (SELECT w.id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.id), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN d ON d.id = w.id WHERE own),
k AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, id) AS place FROM r)
SELECT id AS doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN n_words >= 20 AND place <= (SELECT 5 * count(*) // 100 FROM r WHERE n_words >= 20) THEN place END AS rank FROM k"""

EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id, vec_id AS reached FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reached), c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY 1)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c ON c.vec_id = v.vec_id"""
