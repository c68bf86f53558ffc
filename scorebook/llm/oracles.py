"""SQL of the numbered queries that SQL can express, for DuckDB on the same tables.  It compares every window with every other."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Windows that an equal one comes before, and the maximal runs they cover: start after the first ``lo`` tokens, end ``hi``.
_RUNS = """late AS (SELECT doc_id, lo FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, lo) > 1),
marked AS (SELECT doc_id, lo, CASE WHEN lo > lag(lo) OVER (PARTITION BY doc_id ORDER BY lo) + {size} THEN 1 ELSE 0 END AS new FROM late),
numbered AS (SELECT doc_id, lo, sum(new) OVER (PARTITION BY doc_id ORDER BY lo) AS n FROM marked),
runs AS (SELECT doc_id, min(lo) AS lo, max(lo) + {size} AS hi FROM numbered GROUP BY doc_id, n),
spans AS (SELECT doc_id, list({{'lo': lo, 'hi': hi}} ORDER BY lo) AS s, sum(hi - lo)::BIGINT AS gone FROM runs GROUP BY doc_id)"""

_KEPT = "list_transform(range(0, len(coalesce(s, [])) + 1), lambda k: t[coalesce(s[k].hi, 0) + 1 : coalesce(s[k + 1].lo, {length})])"

SUBSTRING = f"""WITH d AS (SELECT doc_id, {_WORDS} AS t FROM documents),
windows AS (SELECT doc_id, lo, array_to_string(t[lo + 1 : lo + 20], ' ') AS w FROM (SELECT doc_id, t, unnest(range(0, len(t) - 19)) AS lo FROM d)),
{_RUNS.format(size=20)}
SELECT d.doc_id, len(t)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed,
sha256(array_to_string(flatten({_KEPT.format(length='len(t)')}), ' ')) AS kept_sha256
FROM d LEFT JOIN spans USING (doc_id)"""

SUFFIX = f"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
windows AS (SELECT doc_id, lo, md5_number(t[lo + 1 : lo + 100]) AS w FROM (SELECT doc_id, t, unnest(range(0, octet_length(t) - 99)) AS lo FROM d)),
{_RUNS.format(size=100)}
SELECT d.doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, len(coalesce(s, []))::BIGINT AS n_spans,
sha256(unhex(array_to_string(list_transform({_KEPT.format(length='octet_length(t)')}, lambda x: hex(x)), ''))) AS kept_sha256
FROM d LEFT JOIN spans USING (doc_id)"""

JACCARD = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(t[lo + 1 : lo + 4], ' ') AS g FROM (SELECT doc_id, t, unnest(range(0, greatest(len(t) - 3, least(len(t), 1)))) AS lo FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT doc_id, doc_id AS met FROM d UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.met)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(met) AS component_id FROM d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id"""

SQL = {"op5_substring_dedup": SUBSTRING, "op7_suffix_dedup": SUFFIX, "op9_jaccard_join": JACCARD}
