"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

_TOP_K = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER
    AS "rank", vec_id, score
FROM scored QUALIFY "rank" <= 20
"""

_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

_HITS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
       lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
       lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item,
       count(*) / any_value(n_item) AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id
HAVING count(*) * 100 >= any_value(n_item) * 80
"""

_NEAR = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
        lambda x: x <> '') AS w
    FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 1, 1) + 1),
      lambda i: array_to_string(w[i:i + 1], ' '))) AS s FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
          FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM d
          UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
roots AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM roots LEFT JOIN n USING (doc_id)
"""

_NEGATIVES = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
           list_inner_product(a.v, c.v)::BIGINT AS score
    FROM v a JOIN v c ON len(a.v) = len(c.v) AND a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id
           ORDER BY n.score DESC, n.vec_id))::INTEGER AS "rank",
       n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score
QUALIFY "rank" <= 5
"""

#: CRC-32 of a decimal number, bit by bit, with the reflected polynomial.
_CRC = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(
        string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
    lambda s, c: list_reduce(list_prepend(xor(s, c), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END))"""

_TRIE = f"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
    FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS source,
             (xor({_CRC}, 4294967295::UBIGINT) % 6)::BIGINT AS h FROM t),
taken AS (SELECT c.conv_id, place, role, text FROM c JOIN t ON t.conv_id = source WHERE place <= h),
n AS (SELECT conv_id, count(*) AS n FROM taken GROUP BY conv_id),
seq AS (SELECT * FROM taken UNION ALL
        SELECT t.conv_id, place - h + coalesce(n, 0), role, text
        FROM t JOIN c USING (conv_id) LEFT JOIN n USING (conv_id) WHERE place > h),
p AS (SELECT conv_id, place AS depth, length(text) AS chars, sha256(string_agg(
          sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY place)) AS id
      FROM seq
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
up AS (SELECT *, lag(id) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
              lead(id) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM p),
nodes AS (SELECT id, any_value(parent) AS parent, min(conv_id) AS conv_id,
                 any_value(depth) AS depth, count(*) AS n_convs, any_value(chars) AS chars,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)
                     FILTER (WHERE ends), '')) AS ends_sha256
          FROM up GROUP BY id),
kids AS (SELECT parent AS id, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
full_nodes AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (id)),
totals AS (SELECT p.id, sum((f.n_children = 0)::BIGINT) AS n_leaves,
                  sum((f.n_convs - 1) * f.chars) AS saved
           FROM full_nodes f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.id)
SELECT f.conv_id, f.depth::BIGINT AS depth, a.conv_id AS parent_conv_id, f.n_convs, f.n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN totals USING (id) LEFT JOIN nodes a ON a.id = f.parent
"""

ORACLE: dict[str, str] = {
    "op4_top_k": _TOP_K,
    "op9_near_duplicates": _NEAR,
    "op10_benchmark_hits": _HITS,
    "op12_hard_negatives": _NEGATIVES,
    "op13_prefix_trie": _TRIE,
}
