"""SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

_P1 = r"""
WITH m AS (SELECT DISTINCT item_id, set_name FROM set_membership),
h AS (SELECT DISTINCT item_id, regexp_extract(lower(sha256), '[0-9a-f]{64}') AS h FROM items WHERE regexp_matches(lower(sha256), '[0-9a-f]{64}')),
c AS (SELECT DISTINCT item_id, set_name, words FROM descriptors_bits
      WHERE method = 'PDQ' AND dim = 256 AND len(words) = 4 AND words[1] IS NOT NULL AND words[2] IS NOT NULL AND words[3] IS NOT NULL AND words[4] IS NOT NULL),
v0 AS (SELECT DISTINCT item_id, set_name, vec::DOUBLE[96] AS vec FROM descriptors_vec
       WHERE method = 'SSCD-mixup' AND len(vec) = 96 AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT 'sha256' AS channel, q.item_id AS q, r.item_id AS r, m1.set_name FROM h q JOIN h r USING (h)
    JOIN m m1 ON m1.item_id = q.item_id AND m1.set_name IN ('dist', 'neg', 'hard') JOIN m m2 ON m2.item_id = r.item_id AND m2.set_name = 'reg'
  UNION
  SELECT 'PDQ', q.item_id, r.item_id, q.set_name FROM c q JOIN c r
    ON q.set_name IN ('dist', 'neg', 'hard') AND r.set_name = 'reg'
    AND bit_count(xor(q.words[1], r.words[1]))::INTEGER + bit_count(xor(q.words[2], r.words[2]))::INTEGER + bit_count(xor(q.words[3], r.words[3]))::INTEGER + bit_count(xor(q.words[4], r.words[4]))::INTEGER <= 16
  UNION
  SELECT 'SSCD-mixup', q.item_id, r.item_id, q.set_name FROM v0 q JOIN v0 r
    ON q.set_name IN ('dist', 'neg', 'hard') AND r.set_name = 'reg' AND array_cosine_similarity(q.vec, r.vec) >= 0.80)
"""

P1_FOUND = _P1 + "SELECT DISTINCT set_name, least(q, r) AS item_a, greatest(q, r) AS item_b FROM pairs WHERE q <> r"

P1_REPORT = _P1 + r""",
per AS (SELECT q AS item_id, count(DISTINCT r) AS n, max((channel = 'sha256')::INTEGER) AS h, max((channel = 'PDQ')::INTEGER) AS c, max((channel = 'SSCD-mixup')::INTEGER) AS v FROM pairs WHERE q <> r GROUP BY 1),
s AS (SELECT set_name, item_id, coalesce(bool_or(flagged), false) AS flag FROM set_membership WHERE set_name IN ('dist', 'neg', 'hard') AND item_id IS NOT NULL GROUP BY ALL),
src AS (SELECT item_id, max(source) AS source FROM items WHERE item_id IS NOT NULL GROUP BY 1)
SELECT set_name, source, count(*) AS items, count(n) AS overlapping, coalesce(sum(n), 0)::BIGINT AS pairs, coalesce(sum(h), 0)::BIGINT AS by_hash, coalesce(sum(c), 0)::BIGINT AS by_code, coalesce(sum(v), 0)::BIGINT AS by_vector,
  sum(flag::INTEGER)::BIGINT AS flagged, sum((flag AND n IS NOT NULL)::INTEGER)::BIGINT AS flagged_right, sum((NOT flag AND n IS NOT NULL)::INTEGER)::BIGINT AS flag_missing
FROM s LEFT JOIN src USING (item_id) LEFT JOIN per USING (item_id) GROUP BY ALL
"""

_P2 = r"""
WITH t AS (SELECT lower(trim(method)) AS k, min(method) AS method, max(target_pct) AS target_pct FROM thresholds GROUP BY 1),
rec AS (
  SELECT rec_id, min(lower(trim(p.method))) AS k, max(list_max(list_filter(scores, lambda x: x IS NOT NULL AND isfinite(x))))::DOUBLE AS score
  FROM perquery_neg p WHERE cal AND len(list_filter(scores, lambda x: x IS NOT NULL AND isfinite(x))) > 0 GROUP BY rec_id),
r AS (SELECT t.method, t.target_pct, rec_id, score FROM rec JOIN t USING (k)),
c AS (SELECT *, count(*) OVER (PARTITION BY method ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS upto, count(*) OVER (PARTITION BY method) AS total FROM r),
cut AS (SELECT method, max(score) AS cutoff, min(upto) AS kept, any_value(total) AS total FROM c WHERE upto * 100.0 >= target_pct * total GROUP BY method)
"""

P2_FOUND = _P2 + "SELECT r.method, r.rec_id FROM r JOIN cut USING (method) WHERE r.score >= cut.cutoff"

P2_CUTOFFS = _P2 + "SELECT t.method, t.target_pct::DOUBLE AS target_pct, cut.cutoff, coalesce(cut.kept, 0)::BIGINT AS kept, coalesce(cut.total, 0)::BIGINT AS total FROM t LEFT JOIN cut USING (method)"

_P3_SPACE = r"""
{name}_v AS (SELECT DISTINCT d.method, item_id, vec::DOUBLE[{dim}] AS vec FROM descriptors_vec d JOIN methods m ON m.method = d.method
  WHERE d.method = '{name}' AND len(vec) = {dim} AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND ({any_ok} OR len(list_filter(vec, lambda x: x <> 0)) > 0)),
{name}_p AS (SELECT a.method, a.item_id AS a, b.item_id AS b, {sim} AS sim FROM {name}_v a JOIN {name}_v b ON a.item_id <> b.item_id),
{name}_n AS (SELECT method, a, b, sim, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b)::INTEGER AS rank FROM {name}_p QUALIFY rank <= 5 AND sim >= {least})"""


def _p3(lists: bool = False) -> str:
    parts, names = [], []
    for method, dim, ip in (("SSCD-mixup", 96, True), ("DINOv2-S", 64, True), ("ColorMoment", 42, False)):
        sim = "array_cosine_similarity(a.vec, b.vec)" if ip else "-array_distance(a.vec, b.vec)"
        part = _P3_SPACE.format(name=method, dim=dim, any_ok="false" if ip else "true", sim=sim, least="-1e300" if lists else 0.90 if ip else -1.5)
        for suffix in ("_v", "_p", "_n"):
            part = part.replace(method + suffix, f'"{method}{suffix}"')
        parts.append(part)
        names.append(f'SELECT method, a AS item_id, b AS other, rank, CASE WHEN abs(sim) < 5e-6 THEN 0.0::DOUBLE ELSE round(sim, 5) END AS sim FROM "{method}_n"' if lists else f'SELECT method, least(a, b) AS item_a, greatest(a, b) AS item_b FROM "{method}_n"')
    return "WITH " + ",".join(parts) + "\n" + "\nUNION\n".join(names)


_P5_GROUPS = r"""
WITH RECURSIVE e AS (
  SELECT edit_id, max(nullif(regexp_extract(lower(src), '(?:^|[^a-z0-9])(p[a-z0-9]{8})(?:[^a-z0-9]|$)', 1), '')) AS src,
    max(CASE WHEN lower(trim(author)) NOT IN ('', '-', 'n/a', 'unknown') THEN lower(trim(author)) END) AS author
  FROM edits WHERE edit_id IS NOT NULL GROUP BY edit_id),
c AS (SELECT DISTINCT nullif(regexp_extract(lower(item), '(?:^|[^a-z0-9])(p[a-z0-9]{8})(?:[^a-z0-9]|$)', 1), '') AS src, clip FROM config_items),
half AS (
  SELECT 'S' || src AS a, 'A' || author AS b FROM e WHERE src IS NOT NULL AND author IS NOT NULL
  UNION SELECT 'S' || src, 'C' || clip FROM c WHERE src IS NOT NULL AND clip IS NOT NULL),
link AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
node AS (SELECT 'S' || src AS v FROM e WHERE src IS NOT NULL UNION SELECT 'A' || author FROM e WHERE author IS NOT NULL),
reach AS (SELECT v, v AS w FROM node UNION SELECT r.v, l.b FROM reach r JOIN link l ON l.a = r.w),
named AS (SELECT r.v, min(substr(r.w, 2)) AS group_src FROM reach r JOIN node n ON n.v = r.w WHERE r.w LIKE 'S%' GROUP BY r.v)
"""

P5_FOUND = _P5_GROUPS + "SELECT e.edit_id, n.group_src FROM e JOIN named n ON n.v = coalesce('S' || e.src, 'A' || e.author)"

# As weighted_splits does: groups of over 1 % of the weight first, the others by the MD5 of their smallest vertex.
P5_SPLITS = _P5_GROUPS + r""",
vert AS (SELECT edit_id, coalesce('S' || src, 'A' || author, 'E' || edit_id) AS v FROM e),
head AS (SELECT r.v, min(r.w) AS head FROM reach r JOIN (SELECT DISTINCT v FROM vert) x ON x.v = r.w GROUP BY r.v),
g AS (SELECT edit_id, coalesce(h.head, vert.v) AS label FROM vert LEFT JOIN head h USING (v)),
w AS (SELECT label, count(*) AS weight, (SELECT count(*) FROM g) AS total FROM g GROUP BY label),
cum AS (SELECT label, total, sum(weight) OVER (ORDER BY CASE WHEN weight > 0.01 * total THEN weight ELSE 0 END DESC, md5(label), label ROWS UNBOUNDED PRECEDING) - weight AS start FROM w),
p AS (SELECT split_name, sum(share_pct) OVER (ORDER BY share_pct DESC, split_name ROWS UNBOUNDED PRECEDING) * 1.0 / sum(share_pct) OVER () AS upto, row_number() OVER (ORDER BY share_pct DESC, split_name) AS k FROM split_plan WHERE share_pct > 0),
pick AS (SELECT label, arg_min(split_name, k) FILTER (WHERE start < upto * total) AS split_name FROM cum, p GROUP BY label)
SELECT edit_id, split_name FROM g JOIN pick USING (label)
"""

P6_BALANCE = r"""
SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_tokens, true AS whole, true AS within, true AS nearly_full FROM (
  SELECT len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}]+')) AS n FROM documents) WHERE n > 0
"""

P6_FOUND = r"""
SELECT doc_id FROM documents, pack_sizes
WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}]+')) > capacity_tokens
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p2_cutoffs": P2_CUTOFFS, "p3_found": _p3(), "p3_neighbours": _p3(lists=True), "p5_found": P5_FOUND, "p5_splits": P5_SPLITS, "p6_found": P6_FOUND, "p6_balance": P6_BALANCE, "p1_report": P1_REPORT}
