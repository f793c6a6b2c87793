"""DuckDB SQL of the training-data queries that SQL can express, over the same tables."""

from __future__ import annotations

# Words as the contracts have them, unchanged.
_WORDS = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), [])"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(nodes: str, links: str) -> str:
    """c(id, component): the smallest id reachable over links(a, b), both ways, from each of nodes(id)."""
    return f"""e AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}), r AS (SELECT id, id AS to_ FROM {nodes} UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.to_),
 c AS (SELECT id, min(to_) AS component FROM r GROUP BY id)"""


SUBSTRING = f"""WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
 s AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
 f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM s),
 gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM f, range(50) g(j) WHERE first < doc_id),
 kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w) x ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
 SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

EMBEDDING = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
 l AS (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.id < q.id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= 0.95), nodes AS (SELECT vec_id AS id FROM embeddings), {_components('nodes', 'l')}
 SELECT c.id AS vec_id, (SELECT count(*) FROM e WHERE e.a = c.id) AS n_links, component AS component_id, c.id = component AS kept FROM c"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id AS id, {_WORDS.format(_LOWER)} AS w FROM documents),
 s AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)),
 n AS (SELECT id, count(*) AS n FROM s GROUP BY 1), t AS (SELECT p.id AS a, q.id AS b, count(*) AS shared FROM s p JOIN s q ON p.k = q.k AND p.id < q.id GROUP BY 1, 2),
 l AS (SELECT a, b FROM t JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)), nodes AS (SELECT id FROM w), {_components('nodes', 'l')}
 SELECT c.id AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component AS component_id FROM c LEFT JOIN n USING (id)"""

SUFFIX = """WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), p AS (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS i FROM b WHERE octet_length(b) >= 100),
 s AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_slice(b, i, i + 99) ORDER BY doc_id, i) AS rn FROM p), o AS (SELECT doc_id, i, max(i + 99) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s WHERE rn > 1),
 g AS (SELECT doc_id, i, sum(CASE WHEN reach IS NULL OR i > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o), u AS (SELECT doc_id, run, min(i) AS a, max(i) + 99 AS z FROM g GROUP BY 1, 2),
 k AS (SELECT doc_id, coalesce(lag(z) OVER w, 0) + 1 AS a, a - 1 AS z FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY a) UNION ALL SELECT doc_id, max(z) + 1, 1000000000000 FROM u GROUP BY 1),
 h AS (SELECT k.doc_id, string_agg(hex(array_slice(b, k.a, least(k.z, octet_length(b)))), '' ORDER BY k.a) AS kept FROM k JOIN b USING (doc_id) WHERE k.z >= k.a AND k.a <= octet_length(b) GROUP BY 1), m AS (SELECT doc_id, sum(z - a + 1) AS n, count(*) AS spans FROM u GROUP BY 1)
 SELECT b.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(CASE WHEN m.doc_id IS NULL THEN b.b ELSE unhex(coalesce(kept, '')) END) AS kept_sha256 FROM b LEFT JOIN m USING (doc_id) LEFT JOIN h USING (doc_id)"""


# crc32 of ASCII text: a step for each byte over a table of 256 remainders.
_CRC = """RECURSIVE bits AS (SELECT i::BIGINT AS i, 0 AS k, i::BIGINT AS c FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
 crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)"""


def _crc32(text: str, table: str = "crc.t") -> str:
    """Unsigned crc32 of the UTF-8 bytes of text, with crc among the tables."""
    h = f"hex(encode({text}))"
    each = f"list_transform(range(1, len({h}) + 1, 2), lambda i: ('0x' || {h}[i:i + 1])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {each}), lambda c, b: xor(c >> 8, list_extract({table}, xor(c & 255, b) + 1))), 4294967295)"


def _leaf(n_chars: str) -> str:
    field = "coalesce(octet_length(encode(({0})::VARCHAR)) || ':' || ({0})::VARCHAR, '-')"
    return "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


# Levels by recursion; a proof is what stands beside the path, level by level, and a check folds the claim with it.
MERKLE = f"""WITH {_CRC}, l AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf('n_chars')} AS leaf, {_leaf(f"CASE WHEN {_crc32('doc_id::VARCHAR')} % 7 = 0 THEN n_chars + 1 ELSE n_chars END")} AS claim FROM documents, crc),
 p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM l),
 a AS (SELECT tree, 0 AS level, idx, n, leaf AS h FROM p UNION ALL SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM a WHERE n > 1 GROUP BY tree, level, idx // 2, n),
 s AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM a WHERE n = 1),
 b AS (SELECT 0 AS level, idx, n, subroot AS h FROM s UNION ALL SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM b WHERE n > 1 GROUP BY level, idx // 2, n),
 y AS (SELECT p.doc_id, s.tree, 0 AS half, a.level, (p.idx >> a.level) & 1 AS side, z.h AS beside FROM p JOIN s USING (tree) JOIN a ON a.tree = p.tree AND a.n > 1 AND a.idx = p.idx >> a.level LEFT JOIN a z ON z.tree = a.tree AND z.level = a.level AND z.idx = xor(a.idx, 1)
  UNION ALL SELECT p.doc_id, s.tree, 1, b.level, (s.idx >> b.level) & 1, z.h FROM p JOIN s USING (tree) JOIN b ON b.n > 1 AND b.idx = s.idx >> b.level LEFT JOIN b z ON z.level = b.level AND z.idx = xor(b.idx, 1)),
 w AS (SELECT doc_id, tree, list(coalesce(beside, '') ORDER BY half, level) AS beside, list(side ORDER BY half, level) AS side FROM y GROUP BY doc_id, tree),
 v AS (SELECT p.doc_id, tree, leaf, claim AS c, 1 AS k, coalesce(beside, []) AS beside, side FROM p LEFT JOIN w USING (doc_id, tree) UNION ALL SELECT doc_id, tree, leaf, sha256(CASE WHEN side[k] = 1 THEN beside[k] || c ELSE c || beside[k] END), k + 1, beside, side FROM v WHERE k <= len(beside))
 SELECT doc_id, leaf, subroot, (SELECT h FROM b WHERE n = 1) AS root, sha256(coalesce(array_to_string(beside, ''), '')) AS proof_sha256, c AS folded_root, c = (SELECT h FROM b WHERE n = 1) AS verified FROM v JOIN s USING (tree) WHERE k = len(beside) + 1"""


# Near words by what is left of a word without one of its places; chains of forms by recursion.
SPELLING = f"""WITH {_CRC}, x AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
 d AS (SELECT doc_id, run, count(*) AS n FROM x WHERE len(run) >= 7 GROUP BY 1, 2), h AS (SELECT run, n, {_crc32("doc_id || ':' || run")} AS h FROM d, crc),
 g AS (SELECT CASE WHEN h % 31 = 0 THEN run[1:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, n FROM h),
 v AS (SELECT word, sum(n)::BIGINT AS n FROM g WHERE len(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
 k AS (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM v), o AS (SELECT word, n, i, word[1:i - 1] AS a, word[i + 1:] AS z FROM k),
 p AS (SELECT x.word AS word, y.word AS near, y.n AS m FROM o x JOIN o y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT o.word, v.word, v.n FROM o JOIN v ON v.word = o.a || o.z UNION SELECT v.word, o.word, o.n FROM o JOIN v ON v.word = o.a || o.z),
 r AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, near) AS k FROM p),
 f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * v.n THEN near END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN r ON r.word = v.word AND k = 1),
 t AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.next)
 SELECT word, form, t.at AS root, n, n_near, form_n FROM f JOIN t USING (word) WHERE t.next IS NULL"""
