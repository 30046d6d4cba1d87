"""DuckDB SQL for the operators whose results SQL can express."""

LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP2 = rf"""
WITH iw AS (SELECT item_id, regexp_extract_all({LOWER.format('text')}, '{ALNUM}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, i, i + 12) AS k FROM iw, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(k) AS n FROM win),
dw AS (SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '{ALNUM}') AS w FROM documents),
spots AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS k FROM dw, sizes, unnest(range(1, len(w) - n + 2)) t(i)),
hits AS (SELECT DISTINCT doc_id, i, n, k FROM spots WHERE k IN (SELECT k FROM win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) u(p) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                 sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256
          FROM hits JOIN win USING (k) GROUP BY 1)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# the least id reachable by links, walked along all of them
_REACH = """
reach AS (SELECT {id} AS a, {id} AS b FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
comp AS (SELECT a AS {id}, min(b) AS component_id FROM reach GROUP BY 1),
deg AS (SELECT a AS {id}, count(*) AS n_links FROM links GROUP BY 1)"""

OP4 = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
nodes AS (SELECT vec_id FROM v),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
{_REACH.format(id="vec_id")}
SELECT comp.vec_id, coalesce(n_links, 0) AS n_links, component_id, comp.vec_id = component_id AS kept
FROM comp LEFT JOIN deg USING (vec_id)
"""

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT h, max(page_id) AS response FROM p GROUP BY 1)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(sha1(p.h), CAST(j // 8 * 10 + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (j % 8) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM p JOIN m ON m.h = p.h
"""

OP7 = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
spots AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS k FROM dw, unnest(range(1, len(w) - 11)) t(i)),
first AS (SELECT k, min(doc_id) AS d FROM spots GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT spots.doc_id, p FROM spots JOIN first USING (k), unnest(range(i, i + 13)) u(p) WHERE first.d < spots.doc_id),
cut AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY 1)
SELECT dw.doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(coalesce(ps, []), i)), lambda i: w[i]), ' ')) AS kept_sha256
FROM dw LEFT JOIN cut USING (doc_id)
"""

OP8 = rf"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
nodes AS (SELECT doc_id FROM dw),
sh AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS k FROM dw, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n, sum(hash(k)) AS s, sum(hash(k, 1)) AS s2 FROM sh GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 5 * c >= 4 * (p.n + q.n - c)),
{_REACH.format(id="doc_id")},
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY n, s, s2) AS class_id, count(*) OVER (PARTITION BY n, s, s2) AS copies FROM n)
SELECT comp.doc_id, coalesce(class_id, comp.doc_id) AS class_id, coalesce(copies, 1) AS copies, coalesce(n_links, 0) AS n_links,
       component_id, comp.doc_id = component_id AS kept
FROM comp LEFT JOIN deg USING (doc_id) LEFT JOIN cls USING (doc_id)
"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, a hex digit a step."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    # the lower digit of each byte first
    digits = f"list_transform(range(1, CAST(2 * strlen({text}) + 1 AS BIGINT)), lambda j: CAST(instr('0123456789ABCDEF', substr(hex(encode({text})), j + (j % 2) * 2 - 1, 1)) - 1 AS BIGINT))"
    step = f"xor(CAST({table} AS BIGINT[])[(xor(c, x) & 15) + 1], c >> 4)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda c, x: {step}), 4294967295)"


def _leaf(n_chars: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


OP11 = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n,
    {_leaf('n_chars')} AS leaf,
    CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS given FROM documents),
tree AS (SELECT lang, 0 AS lvl, idx, n, leaf AS digest FROM d
  UNION ALL SELECT lang, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY lang, lvl, idx // 2, n),
subs AS (SELECT lang, lvl AS height, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS m FROM tree WHERE n = 1),
top AS (SELECT 0 AS lvl, place AS idx, m AS n, subroot AS digest FROM subs
  UNION ALL SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lvl, idx // 2, n),
steps AS (SELECT d.doc_id, t.lvl AS k, (d.idx >> t.lvl) & 1 AS odd, t.digest AS sibling FROM d
    JOIN tree t ON t.lang IS NOT DISTINCT FROM d.lang AND t.n > 1 AND t.idx = xor(d.idx >> t.lvl, 1)
  UNION ALL SELECT d.doc_id, height + t.lvl, (place >> t.lvl) & 1, t.digest FROM d JOIN subs ON subs.lang IS NOT DISTINCT FROM d.lang
    JOIN top t ON t.n > 1 AND t.idx = xor(place >> t.lvl, 1)),
-- levels without a sibling fold a lone node, too
levels AS (SELECT d.doc_id, t.lvl AS k FROM d JOIN (SELECT DISTINCT lang, lvl FROM tree WHERE n > 1) t ON t.lang IS NOT DISTINCT FROM d.lang
  UNION ALL SELECT d.doc_id, height + t.lvl FROM d JOIN subs ON subs.lang IS NOT DISTINCT FROM d.lang, (SELECT DISTINCT lvl FROM top WHERE n > 1) t),
path AS (SELECT levels.doc_id, string_agg(coalesce(sibling, ''), '' ORDER BY k) AS proof,
    list(CASE WHEN odd = 1 THEN 'L' WHEN odd = 0 THEN 'R' ELSE 'N' END || coalesce(sibling, '') ORDER BY k) AS way
  FROM levels LEFT JOIN steps USING (doc_id, k) GROUP BY 1),
done AS (SELECT d.doc_id, leaf, subroot, (SELECT digest FROM top WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend(given, coalesce(way, [])), lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END)) AS folded_root
  FROM d JOIN subs ON subs.lang IS NOT DISTINCT FROM d.lang LEFT JOIN path USING (doc_id))
SELECT *, folded_root = root AS verified FROM done
"""

OP12 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '{ALNUM}') AS w FROM documents),
iw AS (SELECT regexp_extract_all({LOWER.format('text')}, '{ALNUM}') AS w FROM benchmark),
f AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
t AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM iw),
code AS (SELECT f, {_crc32('f')} % 10000 AS b FROM (SELECT f FROM f UNION SELECT f FROM t)),
fs AS (SELECT doc_id, b FROM f JOIN code USING (f)),
s_all AS (SELECT b, count(*) AS s FROM fs GROUP BY 1),
t_all AS (SELECT b, count(*) AS t FROM t JOIN code USING (f) GROUP BY 1),
gain AS (SELECT b, floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM f) + 10000) / (CAST(s + 1 AS DOUBLE) * ((SELECT count(*) FROM t) + 10000)))) AS gain
         FROM s_all LEFT JOIN t_all USING (b)),
weights AS (SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM fs JOIN gain USING (b) GROUP BY 1),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, 25 * count(*) OVER () // 100 AS k FROM scored WHERE n_words >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN r <= k THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
