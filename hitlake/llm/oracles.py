"""The same questions in DuckDB SQL, where SQL has them."""

from __future__ import annotations

OP5 = r"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS best FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < best THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < best THEN best END AS refers_to FROM m"""
OP6 = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i + 1:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 3, least(len(w), 1)))) AS i FROM d) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS MATERIALIZED (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.h = q.h AND p.doc_id <> q.doc_id GROUP BY 1, 2) x JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""
OP7 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL) x WHERE len(w) >= 5),
bs AS MATERIALIZED (SELECT item_id, n, g, count(*) AS k FROM (SELECT item_id, n, array_to_string(w[i + 1:i + 5], ' ') AS g FROM (SELECT item_id, n, w, unnest(range(n - 4)) AS i FROM b) x) y GROUP BY ALL),
ds AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i + 1:i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS i FROM d WHERE len(w) >= 5) x),
cand AS (SELECT DISTINCT ds.doc_id, bs.item_id, bs.n FROM ds JOIN bs ON bs.g = ds.g),
win AS (SELECT cand.doc_id, item_id, n, unnest(range(len(w) - n + 1)) AS s FROM cand JOIN d ON d.doc_id = cand.doc_id WHERE len(w) >= n),
wc AS (SELECT win.doc_id, win.item_id, win.n, win.s, ds.g, count(*) AS k FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.i BETWEEN win.s AND win.s + win.n - 5 GROUP BY ALL),
sim AS (SELECT wc.doc_id, wc.item_id, wc.n, wc.s, CAST(sum(least(wc.k, coalesce(bs.k, 0))) AS BIGINT) AS shared FROM wc LEFT JOIN bs ON bs.item_id = wc.item_id AND bs.g = wc.g GROUP BY 1, 2, 3, 4),
ranked AS (SELECT *, shared / (2 * (n - 4) - shared) AS similarity, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared DESC, s) AS k FROM sim)
SELECT doc_id, item_id, s AS start, n AS n_words, similarity FROM ranked WHERE k = 1 AND similarity >= 0.8"""
OP8 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s + 1:s + 20], ' ') AS key FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS s FROM d WHERE len(w) >= 20) x),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY key ORDER BY doc_id, s) AS k FROM win) x WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.i) AS t FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i WHERE gone.i IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""


def _op13(rounds: int = 6) -> str:
    """Each round: distances of every part to its codebook's entries, the nearest (ties to the lower), floored means."""
    near = "d{k} AS MATERIALIZED (SELECT c.r, c.part, b.e, CAST(sum((c.v - b.v) * (c.v - b.v)) AS BIGINT) AS d FROM c JOIN b{k} b ON b.part = c.part AND b.pos = c.pos GROUP BY ALL), a{k} AS MATERIALIZED (SELECT r, part, first(e ORDER BY d, e) AS e, min(d) AS d FROM d{k} GROUP BY ALL)"
    mean = "b{n} AS MATERIALIZED (SELECT b.part, b.e, b.pos, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN (SELECT part, e, pos, (s - (s % n + n) % n) // n AS v FROM (SELECT c.part, a.e, c.pos, CAST(sum(c.v) AS BIGINT) AS s, count(*) AS n FROM c JOIN a{k} a ON a.r = c.r AND a.part = c.part GROUP BY ALL) x) m ON m.part = b.part AND m.e = b.e AND m.pos = b.pos)"
    steps = [s.format(k=k, n=k + 1) for k in range(rounds) for s in (near, mean)] + [near.format(k=rounds)]
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
c AS MATERIALIZED (SELECT r, i // (len(x) // 8) AS part, i % (len(x) // 8) AS pos, CAST(floor(4096 * CAST(x[i + 1] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT r, x, unnest(range(len(x))) AS i FROM k) y),
b0 AS (SELECT part, r - 1 AS e, pos, v FROM c WHERE r <= 16),
{", ".join(steps)},
coded AS (SELECT k.vec_id, k.label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} a JOIN k ON k.r = a.r GROUP BY a.r, k.vec_id, k.label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, e, pos)) FROM b{rounds}) AS codebooks_sha256 FROM coded"""


ORACLES = {"op5_warc": OP5, "op6_jaccard": OP6, "op7_decontamination": OP7, "op8_substrings": OP8, "op13_vector_codes": _op13()}
