"""The queries of this folder that SQL can express, for DuckDB."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""
WITH own AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
places AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS win, least(10, len(w)) AS n FROM places),
sizes AS (SELECT DISTINCT n FROM windows),
starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM own JOIN sizes ON len(w) >= n),
found AS (SELECT s.doc_id, s.i, s.n, x.item FROM starts s JOIN windows x ON x.n = s.n AND x.win = array_to_string(s.w[s.i:s.i + s.n - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT o.doc_id, len(o.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
  sha256(coalesce(m.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM own o LEFT JOIN hit h ON h.doc_id = o.doc_id LEFT JOIN named m ON m.doc_id = o.doc_id"""

OP3 = f"""
WITH RECURSIVE texts AS (SELECT coalesce(text, '') AS text, min(doc_id) AS class_id FROM documents GROUP BY 1),
own AS (SELECT class_id, {_WORDS} AS w FROM texts),
places AS (SELECT class_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM own WHERE len(w) > 0),
shingles AS (SELECT DISTINCT class_id, array_to_string(w[i:i + 4], ' ') AS g FROM places),
sizes AS (SELECT class_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (SELECT a.class_id AS x, b.class_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.class_id <> b.class_id GROUP BY 1, 2),
links AS (SELECT p.x, p.y FROM pairs p JOIN sizes a ON a.class_id = p.x JOIN sizes b ON b.class_id = p.y WHERE p.c * 10 >= 8 * (a.n + b.n - p.c)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
groups AS (SELECT x, min(y) AS low FROM reach GROUP BY 1),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY 1)
SELECT d.doc_id, t.class_id, coalesce(c.n, 0) AS n_links, least(t.class_id, coalesce(g.low, t.class_id)) AS group_id
FROM documents d JOIN texts t ON t.text = coalesce(d.text, '') LEFT JOIN counts c ON c.x = t.class_id LEFT JOIN groups g ON g.x = t.class_id"""


def _crc(text: str) -> str:
    """Unsigned crc32 of an ASCII text."""
    step = "lambda x, y: xor(x >> 1, 3988292384 * (x & 1))"
    byte = f"list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), {step})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)), lambda a, b: {byte}), 4294967295)"


_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n_chars}", "text")) + ")"

OP11 = f"""
WITH RECURSIVE own AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_LEAF.format(n_chars="n_chars")} AS leaf, coalesce({_crc("CAST(doc_id AS VARCHAR)")} % 7 = 0, false) AS hit,
    {_LEAF.format(n_chars="(n_chars + 1)")} AS changed
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM own),
below AS (
  SELECT tree, 0 AS level, pos, leaf AS h, n FROM placed
  UNION ALL
  SELECT tree, min(level) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), min((n + 1) // 2) FROM below WHERE n > 1 GROUP BY tree, pos // 2),
subroots AS (SELECT tree, h, level, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM below WHERE n = 1),
above AS (
  SELECT 0 AS level, pos, h, n FROM subroots
  UNION ALL
  SELECT min(level) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), min((n + 1) // 2) FROM above WHERE n > 1 GROUP BY pos // 2),
steps AS (
  SELECT p.tree, p.pos AS spot, b.level AS step, b.pos & 1 AS slot, s.h AS other
  FROM placed p JOIN below b ON b.tree = p.tree AND b.pos = p.pos >> b.level AND b.n > 1
  LEFT JOIN below s ON s.tree = b.tree AND s.level = b.level AND s.pos = xor(b.pos, 1)
  UNION ALL
  SELECT p.tree, p.pos, r.level + a.level, a.pos & 1, s.h
  FROM placed p JOIN subroots r ON r.tree = p.tree JOIN above a ON a.pos = r.pos >> a.level AND a.n > 1
  LEFT JOIN above s ON s.level = a.level AND s.pos = xor(a.pos, 1)),
folded AS (
  SELECT tree, pos, 0 AS step, CASE WHEN hit THEN changed ELSE leaf END AS h FROM placed
  UNION ALL
  SELECT f.tree, f.pos, f.step + 1, sha256(CASE WHEN s.slot = 1 THEN s.other || f.h ELSE f.h || coalesce(s.other, '') END)
  FROM folded f JOIN steps s ON s.tree = f.tree AND s.spot = f.pos AND s.step = f.step),
ends AS (SELECT tree, pos, arg_max(h, step) AS h FROM folded GROUP BY 1, 2),
proofs AS (SELECT tree, spot, sha256(string_agg(other, '' ORDER BY step)) AS h FROM steps WHERE other IS NOT NULL GROUP BY 1, 2)
SELECT p.doc_id, p.leaf, r.h AS subroot, t.h AS root, coalesce(q.h, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = t.h AS verified
FROM placed p JOIN subroots r ON r.tree = p.tree JOIN ends e ON e.tree = p.tree AND e.pos = p.pos
LEFT JOIN proofs q ON q.tree = p.tree AND q.spot = p.pos JOIN (SELECT h FROM above WHERE n = 1) t ON true"""


def _op13(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds as common table expressions: a (assignments) and c (codebook components) of each."""
    nearest = """
a{r} AS MATERIALIZED (SELECT k, p, min(struct_pack(d, e)) AS best FROM (
  SELECT x.k, x.p, c.e, CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS d FROM x JOIN c{r} c ON c.p = x.p AND c.i = x.i GROUP BY 1, 2, 3) GROUP BY 1, 2),"""
    moved = """
m{r} AS MATERIALIZED (SELECT x.p, a.best.e AS e, x.i, CAST(floor_div(sum(x.v), count(*)) AS BIGINT) AS v FROM x JOIN a{r} a ON a.k = x.k AND a.p = x.p GROUP BY 1, 2, 3),
c{s} AS MATERIALIZED (SELECT c.p, c.e, c.i, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.p = c.p AND m.e = c.e AND m.i = c.i),"""
    moved = moved.replace("floor_div(sum(x.v), count(*))", "(sum(x.v) - ((sum(x.v) % count(*)) + count(*)) % count(*)) // count(*)")
    body = "".join(nearest.format(r=r) + moved.format(r=r, s=r + 1) for r in range(rounds)) + nearest.format(r=rounds)
    return f"""
WITH kept AS (SELECT row_number() OVER () AS k, vec_id, label, embedding AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
flat AS (SELECT k, unnest(range(0, len(w))) AS j, unnest(list_transform(w, lambda y: CAST(floor(4096 * CAST(y AS DOUBLE)) AS BIGINT))) AS v, len(w) // {parts} AS width FROM kept),
x AS MATERIALIZED (SELECT k, j // width AS p, j % width AS i, v FROM flat),
firsts AS (SELECT k, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries}),
c0 AS (SELECT x.p, f.e, x.i, x.v FROM x JOIN firsts f ON f.k = x.k),{body}
coded AS (SELECT k, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1),
books AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM c{rounds})
SELECT kept.vec_id, coded.code, coded.error, CAST(sum(coded.error) OVER (PARTITION BY kept.label) AS BIGINT) AS label_error, books.h AS codebooks_sha256
FROM kept JOIN coded ON coded.k = kept.k JOIN books ON true"""


SQL = {"op3_jaccard": OP3, "op5_decontaminate": OP5, "op11_merkle": OP11, "op13_vector_codes": _op13()}
