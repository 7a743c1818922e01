"""Queries on deeply nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veriloom.operators import nested
from veriloom.plans.bindings import table
from veriloom.plans.registry import query

# Sections of complete bodies: top, rows_ and trials_ hold the entries of their levels as JSON.
P4 = r"""
WITH RECURSIVE b0 AS (SELECT record_id, regexp_replace(regexp_replace(body, '^[\s\x{feff}]+', ''), '\s+$', '') AS t FROM raw_records WHERE record_id IS NOT NULL AND body IS NOT NULL),
b1 AS (SELECT record_id, regexp_replace(t, '\bNaN\b', '"NaN"', 'g') AS t FROM b0),
b2 AS (SELECT record_id, CASE WHEN json_valid(t) THEN CASE WHEN json_type(t) = 'VARCHAR' THEN json_extract_string(t, '$') ELSE t END END AS t FROM b1),
b3 AS (SELECT record_id, max(t) AS t FROM b2 WHERE t IS NOT NULL AND json_valid(t) GROUP BY record_id),
kids AS (
  SELECT record_id, 0 AS depth, t::JSON AS j FROM b3
  UNION
  SELECT k.record_id, depth + 1, u.j FROM kids k,
    LATERAL (SELECT unnest(
      CASE WHEN json_type(k.j) = 'OBJECT' THEN
        [x for x in [k.j->'record', k.j->'payload'] if x IS NOT NULL AND json_type(x) = 'OBJECT']
        || CASE WHEN json_type(k.j->'results') = 'ARRAY' THEN (k.j->'results')::JSON[] WHEN json_type(k.j->'results') = 'OBJECT' THEN [k.j->'results'] ELSE [] END
        || [x for x in [CASE WHEN json_type(k.j->'payload') = 'VARCHAR' AND json_valid(k.j->>'payload') THEN (k.j->>'payload')::JSON END] if x IS NOT NULL]
      ELSE [] END) AS j) u
  WHERE depth < 2),
doc AS (SELECT DISTINCT record_id, j FROM kids WHERE json_type(j) = 'OBJECT'),
sec AS (
  SELECT record_id, 'method' AS entity, j->'methods' AS s FROM doc
  UNION ALL SELECT record_id, 'attack', j->'attack_family' FROM doc
  UNION ALL SELECT record_id, 'magnitude', j->'magnitude' FROM doc
  UNION ALL SELECT record_id, 'magnitude', j->'video'->'magnitude' FROM doc),
mem AS (
  SELECT record_id, entity, k AS name, json_extract(s, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(s)) AS k FROM sec WHERE json_type(s) = 'OBJECT')
  UNION ALL
  SELECT record_id, entity, CASE entity WHEN 'method' THEN coalesce(e->>'name', e->>'method') WHEN 'attack' THEN coalesce(e->>'attack', e->>'name') ELSE coalesce(e->>'method', e->>'name') END, e
  FROM (SELECT *, unnest(s::JSON[]) AS e FROM sec WHERE json_type(s) = 'ARRAY') WHERE json_type(e) <> 'NULL'),
top AS (SELECT * FROM mem WHERE v IS NOT NULL AND json_type(v) <> 'NULL'),
rw0 AS (SELECT record_id, name, CASE json_type(v->'rows') WHEN 'ARRAY' THEN (v->'rows')::JSON[] WHEN 'OBJECT' THEN [v->'rows'] END AS l FROM top WHERE entity = 'magnitude'),
rw AS (SELECT record_id, name, unnest(l) AS v, unnest(range(len(l)))::INTEGER AS ord FROM rw0),
rows_ AS (SELECT * FROM rw WHERE v IS NOT NULL AND json_type(v) <> 'NULL'),
tr0 AS (SELECT record_id, name, ord, CASE json_type(v->'trials') WHEN 'ARRAY' THEN (v->'trials')::JSON[] WHEN 'OBJECT' THEN [v->'trials'] END AS l FROM rows_),
tr AS (SELECT record_id, name, ord, unnest(l) AS v, unnest(range(len(l)))::INTEGER AS sub_ord FROM tr0),
trials_ AS (SELECT * FROM tr WHERE v IS NOT NULL AND json_type(v) <> 'NULL')
"""


def _number(field: str) -> str:
    return f"try_cast(v->>'{field}' AS DOUBLE) AS {field}"


_ENTRY = "SELECT record_id, name, max(v::VARCHAR)::JSON AS v FROM top WHERE entity = '{}' GROUP BY ALL"


@query("SCA5 D12", P4 + """
SELECT DISTINCT record_id, entity, name, -1 AS ord, -1 AS sub_ord FROM top
UNION ALL SELECT DISTINCT record_id, 'row', name, ord, -1 FROM rows_ UNION ALL SELECT DISTINCT record_id, 'trial', name, ord, sub_ord FROM trials_""")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.entries(table(spark, d, "raw_records")).select("record_id", "entity", "name", "ord", "sub_ord")


@query("SCA5", P4 + f"""
SELECT record_id, name AS method, {_number('chance')}, {_number('reid_top1')},
  try_cast(CASE json_type(v->'reid_ci') WHEN 'ARRAY' THEN v->'reid_ci'->>0 WHEN 'OBJECT' THEN v->'reid_ci'->>'lo' END AS DOUBLE) AS reid_ci_lo,
  try_cast(CASE json_type(v->'reid_ci') WHEN 'ARRAY' THEN v->'reid_ci'->>1 WHEN 'OBJECT' THEN v->'reid_ci'->>'hi' END AS DOUBLE) AS reid_ci_hi,
  {_number('lpips')}, v->>'train_seconds' AS train_seconds FROM ({_ENTRY.format('method')})""")
def p4_methods(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_tables(table(spark, d, "raw_records"))["methods"]


@query("SCA5", P4 + f"""
SELECT record_id, name AS attack, CASE WHEN json_type(v) = 'OBJECT' THEN v->>'family' ELSE v->>'$' END AS family FROM ({_ENTRY.format('attack')})""")
def p4_attacks(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_tables(table(spark, d, "raw_records"))["attacks"]


@query("SCA5", P4 + f"""
SELECT record_id, name AS method, v->>'speed_median' AS speed_median_text, {_number('speed_median')}, {_number('crop_keep_median')} FROM ({_ENTRY.format('magnitude')})""")
def p4_magnitudes(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_tables(table(spark, d, "raw_records"))["magnitudes"]


@query("SCA5", P4 + f"""
SELECT record_id, name AS method, ord, v->>'clip' AS clip, {_number('crop_keep')}, v->>'speed' AS speed_text, {_number('speed')}
FROM (SELECT record_id, name, ord, max(v::VARCHAR)::JSON AS v FROM rows_ GROUP BY ALL)""")
def p4_rows(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_tables(table(spark, d, "raw_records"))["rows"]


@query("SCA5", P4 + f"""
SELECT record_id, name AS method, ord, sub_ord, {_number('speed')}, v->>'hit' = 'true' AS hit
FROM (SELECT record_id, name, ord, sub_ord, max(v::VARCHAR)::JSON AS v FROM trials_ GROUP BY ALL)""")
def p4_trials(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_tables(table(spark, d, "raw_records"))["trials"]
