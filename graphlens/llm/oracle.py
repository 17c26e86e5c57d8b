"""DuckDB SQL that gives the rows of those ``opN_*`` queries that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array({text}, '{gaps}'), lambda x: x <> '')"
_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WHITE = r"[\x20\x09-\x0D]+"
_NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_EXACT = """SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM (
SELECT doc_id, body, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents))"""

# CRC-32 byte by byte: the table of 256 entries from its rule, then a fold over each text's bytes.
_SHARDS = """WITH crctable AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n) ORDER BY n) AS t FROM range(256) r(n)),
sized AS (SELECT doc_id, coalesce(text, '') AS body, CAST(coalesce(octet_length(encode(text)), 0) + 16 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
grouped AS (SELECT *, min(doc_id) OVER (PARTITION BY body) AS first_id, sum(size) OVER (PARTITION BY body) AS group_size, max(size) OVER () AS largest FROM sized),
summed AS (SELECT *, sum(size) OVER (ORDER BY first_id, doc_id) - size AS before, sum(size) OVER () AS total FROM grouped),
cuts AS (SELECT *, CASE WHEN group_size <= largest THEN min(before) OVER (PARTITION BY body) ELSE before END AS b, CASE WHEN group_size <= largest THEN group_size ELSE size END AS l FROM summed),
placed AS (SELECT *, CAST(least(39, (2 * b + l) * 40 // (2 * total)) AS INT) AS shard FROM cuts)
SELECT doc_id, size, xor(4294967295, list_reduce(list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295)) AS text_crc32,
'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY first_id, doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM placed, crctable"""

_CONTAMINATION = f"""WITH d AS (SELECT doc_id, coalesce({_WORDS.format(text=_LOWER.format(text="text"), gaps=_NOT_ALNUM)}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(text=_LOWER.format(text="text"), gaps=_NOT_ALNUM)} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0), range(1, 100000) r(i) WHERE i + n - 1 <= len(w)),
sizes AS (SELECT DISTINCT n FROM win),
hit AS (SELECT doc_id, item_id, i, n FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), sizes WHERE i + n - 1 <= len(w)) JOIN win USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""

_SUBSTRINGS = f"""WITH d AS (SELECT doc_id, coalesce({_WORDS.format(text="text", gaps=_WHITE)}, []) AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM win) WHERE first < doc_id),
marks AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN marks USING (doc_id) LEFT JOIN kept USING (doc_id)"""


# Runs grow by one line as long as several positions have them; a position's longest with an earlier one is its lcp.
_LINES = """WITH RECURSIVE lines AS (SELECT doc_id, unnest(range(0, len(l))) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
named AS (SELECT doc_id, n, md5(line) AS h FROM lines),
step AS (SELECT doc_id, n, 1 AS len, h AS g FROM named
UNION ALL SELECT s.doc_id, s.n, s.len + 1 AS len, md5(s.g || l.h) AS g FROM (SELECT *, count(*) OVER (PARTITION BY g) AS members FROM step) s JOIN named l ON l.doc_id = s.doc_id AND l.n = s.n + s.len WHERE members > 1),
lcp AS (SELECT doc_id, n, max(len) AS len FROM (SELECT *, row_number() OVER (PARTITION BY len, g ORDER BY doc_id, n) AS c FROM step) WHERE c > 1 AND len >= 2 GROUP BY doc_id, n),
gone AS (SELECT DISTINCT doc_id, unnest(range(n, n + 2)) AS n FROM lcp),
heads AS (SELECT a.doc_id, count(*) AS n_runs, max(a.len) AS longest_run FROM lcp a LEFT JOIN lcp b ON b.doc_id = a.doc_id AND b.n = a.n - 1 WHERE b.len IS NULL OR b.len <> a.len + 1 GROUP BY a.doc_id),
kept AS (SELECT doc_id, count(*) AS n_lines, count(g.n) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.n) FILTER (g.n IS NULL), '') AS t FROM lines l LEFT JOIN gone g USING (doc_id, n) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, coalesce(longest_run, 0) AS longest_run, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN heads USING (doc_id)"""


_VECTORS = """WITH RECURSIVE ok AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) END >= 0.93),
reach AS (SELECT vec_id, vec_id AS there FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.there = l.a),
top AS (SELECT vec_id, min(there) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM top LEFT JOIN n ON n.a = vec_id"""

_TERMS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_SEARCH = f"""WITH d AS (SELECT doc_id, {_TERMS.format(text="text")} AS w FROM documents WHERE text IS NOT NULL),
sized AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized),
tfs AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM sized) GROUP BY doc_id, n, t),
dfs AS (SELECT t, count(*) AS df FROM tfs GROUP BY t),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({_TERMS.format(text="text")}) AS t FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, t),
scored AS (SELECT item_id, doc_id, CAST(sum(c * CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
FROM q JOIN tfs USING (t) JOIN dfs USING (t), total GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"""

_MIDDLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents),
x AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256 FROM p"""


ORACLE_SQL = {
    "op2_line_dedup": _LINES,
    "op3_exact_dedup": _EXACT,
    "op5_sharding": _SHARDS,
    "op8_decontaminate": _CONTAMINATION,
    "op9_substring_dedup": _SUBSTRINGS,
    "op11_embedding_dedup": _VECTORS,
    "op12_ranked_search": _SEARCH,
    "op13_fill_in_middle": _MIDDLE,
}
