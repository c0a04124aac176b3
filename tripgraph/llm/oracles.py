"""DuckDB SQL for those operators that SQL can express."""

from __future__ import annotations

_LOWER = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _component(links: str, nodes: str) -> str:
    """CTE parts: ``reach`` closes the links, ``root`` has each node's smallest
    reachable id. ``links`` holds both directions."""
    return f"""
reach AS (SELECT a, b FROM {links} UNION SELECT r.a, l.b FROM reach r JOIN {links} l ON r.b = l.a),
root AS (SELECT n.id, least(n.id, COALESCE(min(r.b), n.id)) AS component_id FROM {nodes} n LEFT JOIN reach r ON n.id = r.a GROUP BY n.id)"""


def near_dedup(per_cent: int, shingle: int = 5) -> str:
    """Every pair that shares a shingle, by the sizes of their sets."""
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{word}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {shingle - 1}], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {shingle - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0) x),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= {per_cent} * (x.n + y.n - c)),
node AS (SELECT DISTINCT doc_id AS id FROM documents),{_component('link', 'node')}
SELECT d.doc_id, CAST(COALESCE(s.n, 0) AS BIGINT) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d JOIN root r ON d.doc_id = r.id LEFT JOIN size s ON d.doc_id = s.doc_id"""


def near_vectors(least: float) -> str:
    """All pairs by cosine."""
    return f"""
WITH RECURSIVE e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
link AS (SELECT x.id AS a, y.id AS b FROM e x JOIN e y ON x.id <> y.id AND list_cosine_similarity(x.v, y.v) >= {least}),
node AS (SELECT id FROM e),{_component('link', 'node')}
SELECT r.id AS vec_id, (SELECT count(*) FROM link l WHERE l.a = r.id) AS n_links, r.component_id, r.id = r.component_id AS kept FROM root r"""


def contamination(window: int = 10) -> str:
    """Windows of items, looked up at every place of every document."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    cut = "array_to_string(w[i:i + n - 1], ' ')"
    return f"""
WITH iw AS (SELECT item_id, regexp_extract_all({_LOWER}, '{word}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, {cut} AS s FROM (
  SELECT item_id, w, least(len(w), {window}) AS n, unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS i FROM iw WHERE len(w) > 0) x),
dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{word}') AS w FROM documents),
place AS (SELECT doc_id, i, n, {cut} AS s FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) k WHERE len(w) >= n) x),
found AS (SELECT p.doc_id, p.i, p.n, m.item_id FROM place p JOIN win m ON p.s = m.s AND p.n = m.n),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) x GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
         FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, COALESCE(h.n_hit, 0) AS n_hit, COALESCE(t.n_items, 0) AS n_items,
       sha256(COALESCE(t.items, '')) AS items_sha256, COALESCE(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN item t ON d.doc_id = t.doc_id"""


def archive() -> str:
    """Digests of whole payloads; base32 by its definition, five bits a digit."""
    digit = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    bits = "array_to_string(list_transform(range(1, 41), lambda k: lpad(bin(CAST(instr('0123456789abcdef', substring(x, k, 1)) - 1 AS BIGINT)), 4, '0')), '')"
    five = "substring(bits, 5 * k + 1, 5)"
    value = " + ".join(f"CAST(substring({five}, {j + 1}, 1) AS INTEGER) * {16 >> j}" for j in range(5))
    return f"""
WITH p AS (SELECT page_id, encode(COALESCE(html, '')) AS payload, sha1(COALESCE(html, '')) AS x FROM pages),
b AS (SELECT page_id, octet_length(payload) AS payload_bytes, {bits} AS bits FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: substring({digit}, {value} + 1, 1)), '') AS payload_digest FROM b),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS head FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < head THEN head END AS refers_to, true AS verified FROM m"""


def filter_audit() -> str:
    """Every order step by step from the cells of failure masks: a step keeps the cells that no filter so far fails."""
    text = "COALESCE(text, '')"
    word = r"[^\x20\x09-\x0D]+"
    bits = "(CASE WHEN a THEN 1 ELSE 0 END + CASE WHEN b THEN 2 ELSE 0 END + CASE WHEN c THEN 4 ELSE 0 END + CASE WHEN d THEN 8 ELSE 0 END + CASE WHEN e THEN 16 ELSE 0 END)"
    of = lambda k: f"(1 << (ascii(filter_order[{k}]) - 65))"
    orders = " ".join(f"CROSS JOIN f f{k}" for k in range(2, 6))
    apart = " AND ".join(f"f{i}.x <> f{j}.x" for i in range(1, 6) for j in range(i + 1, 6))
    before = " + ".join(f"CASE WHEN s.step > {k} THEN {of(k)} ELSE 0 END" for k in range(1, 5))
    return f"""
WITH w AS (SELECT doc_id, COALESCE(source, '') AS part, {text} AS t, regexp_extract_all({text}, '{word}') AS w FROM documents),
fails AS (SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    COALESCE(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e FROM w),
lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
cell AS (SELECT part, {bits} AS mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
         FROM fails LEFT JOIN lab USING (doc_id) GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT f1.x || f2.x || f3.x || f4.x || f5.x AS filter_order FROM f f1 {orders} WHERE {apart}),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
b AS (SELECT filter_order, CAST(step AS INTEGER) AS step, {before} AS before, (1 << (ascii(filter_order[s.step]) - 65)) AS own FROM s),
r AS (SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before > 0 AND mask & own > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM b CROSS JOIN cell GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""


def _crc32(text: str) -> str:
    """CRC-32 of a decimal number by its definition, bit by bit."""
    byte = "list_reduce(range(8), lambda r, k: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, v))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda d: CAST(ascii(d) AS BIGINT)), lambda c, v: {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"


def manifest(arity: int = 8) -> str:
    """Levels by a recursion over grouped digests, proofs from the levels, folds by a recursion per leaf."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def leaf(text):
        parts = [("doc_id", "CAST(doc_id AS VARCHAR)"), ("source", "source"), ("lang", "lang"), ("n_chars", "CAST(n_chars AS VARCHAR)"), ("text", text)]
        return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({v})) || ':' || {v} END" for c, v in parts) + ")"

    def levels(name, start):
        return f"""
{name} AS ({start} UNION ALL
  SELECT g, lvl + 1, pos // {arity}, (n + {arity - 1}) // {arity}, sha256(string_agg(d, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // {arity}, n)"""

    return f"""
WITH RECURSIVE x AS (SELECT doc_id, lang, {leaf('text')} AS leaf, {leaf(f"CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {lower} ELSE text END")} AS bad FROM documents),
grp AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM documents) q),
l AS (SELECT x.*, g, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM x JOIN grp ON x.lang IS NOT DISTINCT FROM grp.lang),
{levels('a', 'SELECT g, 0 AS lvl, pos, n, leaf AS d FROM l')},
sub AS (SELECT g, lvl, d FROM a WHERE n = 1),
{levels('t', 'SELECT CAST(-1 AS BIGINT) AS g, 0 AS lvl, g AS pos, count(*) OVER () AS n, d FROM sub')},
node AS (SELECT g, lvl, pos, d FROM a WHERE n > 1 UNION ALL SELECT g, lvl, pos, d FROM t WHERE n > 1),
run AS (SELECT g, lvl, pos // {arity} AS run, list(d ORDER BY pos) AS ds FROM node GROUP BY 1, 2, 3),
root AS (SELECT d AS root FROM t WHERE n = 1),
fold AS (SELECT l.g AS leaf_g, l.pos AS leaf_pos, 0 AS step, l.g AS g, 0 AS lvl, l.pos AS pos, l.n AS n, bad AS d, '' AS sib FROM l
  UNION ALL
  SELECT leaf_g, leaf_pos, step, g, lvl, pos, n, d, sib FROM (
    SELECT f.leaf_g, f.leaf_pos, f.step + 1 AS step, r.g, r.lvl + 1 AS lvl, r.run AS pos, (f.n + {arity - 1}) // {arity} AS n,
           sha256(array_to_string(list_transform(r.ds, lambda v, k: CASE WHEN k = f.pos % {arity} + 1 THEN f.d ELSE v END), '')) AS d,
           array_to_string(list_filter(r.ds, lambda v, k: k <> f.pos % {arity} + 1), '') AS sib
    FROM fold f JOIN run r ON f.n > 1 AND f.g = r.g AND f.lvl = r.lvl AND f.pos // {arity} = r.run
    UNION ALL
    SELECT f.leaf_g, f.leaf_pos, f.step + 1, -1, 0, f.g, (SELECT count(*) FROM grp), f.d, '' FROM fold f WHERE f.n = 1 AND f.g >= 0) z),
proof AS (SELECT leaf_g, leaf_pos, sha256(string_agg(sib, '' ORDER BY step)) AS proof_sha256, arg_max(d, step) AS folded_root FROM fold GROUP BY 1, 2)
SELECT doc_id, leaf, sub.d AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN sub ON l.g = sub.g JOIN proof ON l.g = leaf_g AND l.pos = leaf_pos CROSS JOIN root"""


def line_dedup(min_chars: int = 10, min_docs: int = 2) -> str:
    """Lines by position, keys by the documents that hold them."""
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH s AS (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS line_no FROM s),
k AS (SELECT *, translate(trim(line, {space}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs}),
m AS (SELECT k.*, COALESCE(c.owner < k.doc_id, false) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(COALESCE(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""
