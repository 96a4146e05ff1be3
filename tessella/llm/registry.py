"""Queries of this subpackage and the SQL that says what they return."""

from __future__ import annotations

from .ann import op6_posting_list_ann
from .bpe import op2_bpe_streaming
from .decontaminate import op9_positional_decontamination
from .funnel import op11_forward_sweep_funnels
from .hmm import op1_hmm_language_model
from .lexical import op13_max_tree_search
from .neardup import op5_bbit_minhash
from .sharding import op8_stratified_sharding
from .simhash import op12_vantage_point_simhash
from .substring import op10_suffix_tree_dedup
from .toxicity import op7_max_segment_toxicity
from .vbyte import op3_vbyte_ids
from .warc import op4_warc_chunks

_ALL = [op1_hmm_language_model, op2_bpe_streaming, op3_vbyte_ids, op4_warc_chunks, op5_bbit_minhash, op6_posting_list_ann, op7_max_segment_toxicity, op8_stratified_sharding, op9_positional_decontamination, op10_suffix_tree_dedup, op11_forward_sweep_funnels, op12_vantage_point_simhash, op13_max_tree_search]
_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc_chunks": """
WITH p AS (SELECT page_id, coalesce(html, '') h, sha1(coalesce(html, '')) x FROM pages),
m AS (SELECT h, max(page_id) top FROM p GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END record_type, CASE WHEN page_id = top THEN NULL ELSE top END refers_to
FROM p JOIN m ON p.h = m.h""",
        "op5_bbit_minhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, CAST(len(ws) - 3 AS BIGINT)), lambda i: array_to_string(ws[i:i + 4], ' ')) END) g FROM w),
e AS (SELECT doc_id, unnest(g) x FROM s),
c AS (SELECT a.doc_id a, b.doc_id b, count(*) n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT c.a, c.b FROM c JOIN s p ON p.doc_id = c.a JOIN s q ON q.doc_id = c.b WHERE 100 * n >= 85 * (len(p.g) + len(q.g) - n)),
y AS (SELECT a x, b y FROM k UNION SELECT b, a FROM k),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y.y, r.c FROM r JOIN y ON y.x = r.id),
f AS (SELECT id, min(c) c FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(g) AS BIGINT) n_shingles, f.c component_id, s.doc_id = f.c kept FROM s JOIN f ON f.id = s.doc_id""",
        "op9_positional_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) item, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM benchmark),
v AS (SELECT DISTINCT item, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') x, least(13, len(w)) n FROM i, unnest(range(1, CAST(len(w) - least(13, len(w)) + 2 AS BIGINT))) t(s) WHERE len(w) > 0),
l AS (SELECT DISTINCT n FROM v),
p AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') x FROM d, l, unnest(range(1, CAST(greatest(len(w) - n + 2, 1) AS BIGINT))) t(s)),
h AS (SELECT p.doc_id, p.s, p.n, v.item FROM p JOIN v ON p.x = v.x AND p.n = v.n),
o AS (SELECT doc_id, count(DISTINCT q) n_hit FROM h, unnest(range(s, s + n)) t(q) GROUP BY doc_id),
j AS (SELECT doc_id, count(DISTINCT item) n_items, array_to_string(list_sort(list_distinct(list(item))), ',') items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN o ON o.doc_id = d.doc_id LEFT JOIN j ON j.doc_id = d.doc_id""",
        "op11_forward_sweep_funnels": """
WITH c AS (SELECT DISTINCT client_id, kind, ts FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL),
f AS (SELECT * FROM (VALUES ('A', 'view', 'click', 'view', 'purchase', 'error'), ('B', 'signup', 'view', 'click', 'purchase', 'error'), ('C', 'click', 'click', 'purchase', 'view', 'signup')) v(funnel, k1, k2, k3, k4, ex)),
a1 AS (SELECT funnel, client_id, ts x1, k2, k3, k4, ex FROM f JOIN c ON c.kind = f.k1),
a2 AS (SELECT a1.funnel, a1.client_id, a1.x1, min(c.ts) x2 FROM a1 JOIN c ON c.client_id = a1.client_id AND c.kind = a1.k2 AND c.ts > a1.x1 AND c.ts <= a1.x1 + INTERVAL 60 MINUTE GROUP BY ALL),
b2 AS (SELECT DISTINCT a2.*, k3, k4, ex FROM a2 JOIN f ON f.funnel = a2.funnel),
g2 AS (SELECT * FROM b2 WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.client_id = b2.client_id AND c.kind = b2.ex AND c.ts > b2.x1 AND c.ts <= b2.x2)),
a3 AS (SELECT g2.funnel, g2.client_id, g2.x1, g2.x2, min(c.ts) x3 FROM g2 JOIN c ON c.client_id = g2.client_id AND c.kind = g2.k3 AND c.ts > g2.x2 AND c.ts <= g2.x2 + INTERVAL 60 MINUTE GROUP BY ALL),
b3 AS (SELECT a3.*, k4, ex FROM a3 JOIN f ON f.funnel = a3.funnel),
g3 AS (SELECT * FROM b3 WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.client_id = b3.client_id AND c.kind = b3.ex AND c.ts > b3.x2 AND c.ts <= b3.x3)),
a4 AS (SELECT g3.funnel, g3.client_id, g3.x1, g3.x3, min(c.ts) x4 FROM g3 JOIN c ON c.client_id = g3.client_id AND c.kind = g3.k4 AND c.ts > g3.x3 AND c.ts <= g3.x3 + INTERVAL 60 MINUTE GROUP BY ALL),
b4 AS (SELECT a4.*, ex FROM a4 JOIN f ON f.funnel = a4.funnel),
g4 AS (SELECT * FROM b4 WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.client_id = b4.client_id AND c.kind = b4.ex AND c.ts > b4.x3 AND c.ts <= b4.x4)),
s AS (SELECT funnel, client_id, 2 step, epoch_us(x2) - epoch_us(x1) d FROM g2 UNION ALL SELECT funnel, client_id, 3, epoch_us(x3) - epoch_us(x2) FROM g3 UNION ALL SELECT funnel, client_id, 4, epoch_us(x4) - epoch_us(x3) FROM g4),
r AS (SELECT funnel, client_id, step, d, row_number() OVER (PARTITION BY funnel, client_id, step ORDER BY d) p, count(*) OVER (PARTITION BY funnel, client_id, step) n FROM s),
t AS (SELECT funnel, client_id, max(CASE WHEN step = 2 THEN n END) n2, max(CASE WHEN step = 3 THEN n END) n3, max(CASE WHEN step = 4 THEN n END) n4,
  max(CASE WHEN step = 2 AND p = (90 * n + 99) // 100 THEN d END) t2, max(CASE WHEN step = 3 AND p = (90 * n + 99) // 100 THEN d END) t3, max(CASE WHEN step = 4 AND p = (90 * n + 99) // 100 THEN d END) t4 FROM r GROUP BY funnel, client_id),
o AS (SELECT funnel, client_id, count(*) n1 FROM a1 GROUP BY funnel, client_id),
q AS (SELECT o.funnel, o.client_id, n1, coalesce(n2, 0) n2, coalesce(n3, 0) n3, coalesce(n4, 0) n4, CAST(CASE WHEN n4 > 0 THEN 4 WHEN n3 > 0 THEN 3 WHEN n2 > 0 THEN 2 ELSE 1 END AS INTEGER) deepest, t2, t3, t4
  FROM o LEFT JOIN t ON t.funnel = o.funnel AND t.client_id = o.client_id)
SELECT funnel, client_id, CAST(n1 AS BIGINT) n1, CAST(n2 AS BIGINT) n2, CAST(n3 AS BIGINT) n3, CAST(n4 AS BIGINT) n4, deepest, t2, t3, t4, count(*) OVER (PARTITION BY funnel, deepest) same_depth FROM q""",
        "op13_max_tree_search": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_TERM}') w FROM documents),
g AS (SELECT count(*) n, CAST(sum(len(w)) AS BIGINT) l FROM d WHERE len(w) > 0),
q AS (SELECT item_id, x, count(*) r FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) x FROM benchmark) GROUP BY item_id, x),
p AS (SELECT doc_id, n, x, count(*) tf FROM (SELECT doc_id, len(w) n, unnest(w) x FROM d) WHERE x IN (SELECT x FROM q) GROUP BY doc_id, n, x),
f AS (SELECT x, CAST(floor(1000 * ln((2 * g.n + 2) / (2 * count(*) + 1))) AS BIGINT) weight FROM p, g GROUP BY x, g.n),
s AS (SELECT q.item_id, p.doc_id, CAST(sum(q.r * f.weight * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * g.n) // g.l)))) AS BIGINT) score
  FROM q JOIN p ON p.x = q.x JOIN f ON f.x = q.x, g GROUP BY q.item_id, p.doc_id),
r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) "rank" FROM s WHERE score > 0)
SELECT item_id, "rank", doc_id, score FROM r WHERE "rank" <= 20""",
        "op10_suffix_tree_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w FROM documents),
p AS (SELECT doc_id, s, hash(array_to_string(w[s:s + 19], ' ')) a, md5_number(array_to_string(w[s:s + 19], ' ')) b FROM d, unnest(range(1, CAST(greatest(len(w) - 18, 1) AS BIGINT))) t(s)),
r AS (SELECT doc_id, s FROM p QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY doc_id, s) > 1),
g AS (SELECT doc_id, list(DISTINCT q) q FROM r, unnest(range(s, s + 20)) t(q) GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) n, coalesce(len(g.q), 0) gone, list_filter(w, lambda x, i: g.q IS NULL OR NOT list_contains(g.q, i)) kept FROM d LEFT JOIN g ON g.doc_id = d.doc_id)
SELECT doc_id, CAST(n AS BIGINT) n_words, CAST(gone AS BIGINT) n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) kept_sha256 FROM k""",
    }
