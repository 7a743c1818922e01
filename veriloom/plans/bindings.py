"""How the operators are bound to the test tables: roles, transformations and decodes, in Spark and in SQL.

Registered items are the set ``reg``, distractors ``dist``, negative sources
``neg``. Positive queries are transformed descriptors of registered items,
negative queries those of negative sources.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.operators import retrieval
from veriloom.plans.session import spread

#: The transformations of descriptors and their families.
ATTACKS = (("none", "none"), ("trunc", "crop"), ("quant", "compression"), ("noise", "photometric"), ("flip", "geometric"), ("chain", "chain"))
VECTOR_METHOD, VECTOR_DIM = "DINOv2-S", 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usable_vectors(spark: SparkSession, d: str, method: str, dim: int, nonzero: bool = True) -> DataFrame:
    """(set_name, item_id, v): the distinct usable descriptors of a method, as doubles."""
    v = F.col("vec")
    t = table(spark, d, "descriptors_vec").where((F.col("method") == method) & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))))
    if nonzero:
        t = t.where(F.exists(v, lambda x: x != 0))
    return spread(t.select("set_name", "item_id", "vec")).distinct().select("set_name", "item_id", F.col("vec").cast("array<double>").alias("v"))


def transformed(v: np.ndarray, attack: np.ndarray) -> np.ndarray:
    """Unit vectors under the transformation of each row, of unit length again."""
    out = v.copy()
    cut = np.where(np.arange(v.shape[1]) < 3 * v.shape[1] // 4, v, 0.0)
    for name, new in (("trunc", cut), ("quant", np.round(v, 1)), ("noise", v + 0.05 * np.sin(np.arange(v.shape[1]) * 7.0)), ("flip", v[:, ::-1]), ("chain", np.round(cut, 1))):
        out[attack == name] = new[attack == name]
    return retrieval.unit(out)


def flagged(spark: SparkSession, d: str, set_name: str) -> DataFrame:
    """The items of a set that an earlier cleanup marked as near-duplicates."""
    return table(spark, d, "set_membership").where((F.col("set_name") == set_name) & F.col("flagged") & F.col("item_id").isNotNull()).select("item_id").distinct()


def references(spark: SparkSession, d: str) -> DataFrame:
    """(ref_id, ref) of the registered items and of the distractors that no earlier cleanup flagged, of unit length."""
    v = retrieval.without(usable_vectors(spark, d, VECTOR_METHOD, VECTOR_DIM), flagged(spark, d, "dist"), "item_id")
    return v.where(F.col("set_name").isin("reg", "dist")).select(F.col("item_id").alias("ref_id"), retrieval.normalised(F.col("v")).alias("ref"))


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, source_id, positive, attack, family, query): each registered item and negative source under each transformation."""
    v = usable_vectors(spark, d, VECTOR_METHOD, VECTOR_DIM).where(F.col("set_name").isin("reg", "neg"))
    v = v.select(F.col("item_id").alias("source_id"), (F.col("set_name") == "reg").alias("positive"), retrieval.normalised(F.col("v")).alias("v"))
    kinds = F.explode(F.array(*[F.struct(F.lit(a).alias("attack"), F.lit(f).alias("family")) for a, f in ATTACKS]))
    q = v.withColumn("k", kinds).select("source_id", "positive", "k.attack", "k.family", retrieval.rowwise(transformed, F.col("v"), F.col("k.attack")).alias("query"))
    return q.withColumn("query_id", F.concat_ws("|", "source_id", "attack"))


def searched(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """(query_id, source_id, positive, attack, family, rank, ref_id, score): the best references of every query."""
    q = vector_queries(spark, d)
    found = retrieval.top_k(q.select("query_id", "query"), references(spark, d), k, "ip", VECTOR_DIM)
    return found.join(q.drop("query"), "query_id")


#: The same in SQL: ``refs``, ``queries`` and ``topk``.
SEARCH_SQL = r"""
v0 AS (SELECT DISTINCT set_name, item_id, vec FROM descriptors_vec WHERE method = 'DINOv2-S' AND len(vec) = 64
       AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
v1 AS (SELECT set_name, item_id, list_transform(vec, lambda x: x::DOUBLE) AS v FROM v0),
v AS (SELECT set_name, item_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM v1),
refs AS (SELECT item_id AS ref_id, v AS ref FROM v WHERE set_name IN ('reg', 'dist') AND item_id NOT IN (SELECT item_id FROM set_membership WHERE set_name = 'dist' AND flagged AND item_id IS NOT NULL)),
att(attack, family) AS (VALUES ('none', 'none'), ('trunc', 'crop'), ('quant', 'compression'), ('noise', 'photometric'), ('flip', 'geometric'), ('chain', 'chain')),
raw AS (SELECT item_id AS source_id, set_name = 'reg' AS positive, attack, family,
  CASE attack WHEN 'trunc' THEN list_transform(v, lambda x, i: CASE WHEN i <= 48 THEN x ELSE 0.0 END) WHEN 'quant' THEN list_transform(v, lambda x: round(x, 1))
    WHEN 'noise' THEN list_transform(v, lambda x, i: x + 0.05 * sin((i - 1)::DOUBLE * 7.0)) WHEN 'flip' THEN list_reverse(v)
    WHEN 'chain' THEN list_transform(v, lambda x, i: CASE WHEN i <= 48 THEN round(x, 1) ELSE 0.0 END) ELSE v END AS w
  FROM v, att WHERE set_name IN ('reg', 'neg')),
queries AS (SELECT source_id || '|' || attack AS query_id, source_id, positive, attack, family, list_transform(w, lambda x: x / greatest(sqrt(list_dot_product(w, w)), 1e-12)) AS query FROM raw),
scored AS (SELECT query_id, ref_id, round(list_dot_product(query, ref), 9) AS score FROM queries, refs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) AS rank FROM scored),
topk AS (SELECT q.query_id, source_id, positive, attack, family, rank, ref_id, score FROM ranked JOIN queries q USING (query_id) WHERE rank <= 10)
"""


def md5_word(*parts: Column) -> Column:
    """The first 60 bits of the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("bigint")


def sql_word(*parts: str) -> str:
    joined = ", ".join(parts)
    return f"('0x' || substr(md5(concat_ws(':', {joined})), 1, 15))::BIGINT"


#: Payload configurations (name, bits, family) and transformations of the payload channel (name, hashes whose common bits flip).
CONFIGS = (("alpha", 32, "A"), ("beta", 48, "A"), ("gamma", 60, "B"))
CHANNEL = (("none", 0), ("light", 4), ("medium", 2), ("heavy", 1))
RANDOM_KEYS = 50


def decodes(spark: SparkSession, d: str) -> DataFrame:
    """(config, nbits, family, doc_id, source, attack, key, decoded, matches, bit_acc): every document's payload through every channel."""
    docs = spread(table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("missing")).alias("source")))
    configs = F.explode(F.array(*[F.struct(F.lit(n).alias("config"), F.lit(b).alias("nbits"), F.lit(f).alias("family")) for n, b, f in CONFIGS]))
    attacks = F.explode(F.array(*[F.struct(F.lit(n).alias("attack"), F.lit(h).alias("hashes")) for n, h in CHANNEL]))
    r = docs.withColumn("c", configs).select("doc_id", "source", "c.*").withColumn("a", attacks).select("*", "a.*").drop("a")
    mask = F.expr("shiftleft(cast(1 as bigint), nbits)") - 1
    draws = [md5_word(F.lit(f"flip{i}"), F.col("config"), F.col("attack"), F.col("doc_id").cast("string")) for i in range(4)]
    flips = F.when(F.col("hashes") == 0, F.lit(0).cast("bigint")).when(F.col("hashes") == 1, draws[0]).when(F.col("hashes") == 2, draws[0].bitwiseAND(draws[1])).otherwise(draws[0].bitwiseAND(draws[1]).bitwiseAND(draws[2]).bitwiseAND(draws[3]))
    r = r.withColumn("mask", mask).withColumn("key", md5_word(F.lit("key"), F.col("config"), F.col("doc_id").cast("string")).bitwiseAND(F.col("mask")))
    r = r.withColumn("decoded", F.col("key").bitwiseXOR(flips.bitwiseAND(F.col("mask"))))
    r = r.withColumn("matches", F.col("nbits") - F.bit_count(F.col("key").bitwiseXOR(F.col("decoded"))))
    return r.withColumn("bit_acc", F.col("matches") / F.col("nbits")).drop("mask", "hashes")


DECODES_SQL = f"""
cfg(config, nbits, family) AS (VALUES {', '.join(f"('{n}', {b}, '{f}')" for n, b, f in CONFIGS)}),
chn(attack, hashes) AS (VALUES {', '.join(f"('{n}', {h})" for n, h in CHANNEL)}),
d0 AS (SELECT config, nbits, family, doc_id, coalesce(source, 'missing') AS source, attack, hashes, ((1::BIGINT << nbits) - 1) AS mask,
  {sql_word("'key'", 'config', 'doc_id')} & ((1::BIGINT << nbits) - 1) AS key,
  {sql_word("'flip0'", 'config', 'attack', 'doc_id')} AS f0, {sql_word("'flip1'", 'config', 'attack', 'doc_id')} AS f1,
  {sql_word("'flip2'", 'config', 'attack', 'doc_id')} AS f2, {sql_word("'flip3'", 'config', 'attack', 'doc_id')} AS f3
  FROM documents, cfg, chn),
d1 AS (SELECT *, xor(key, mask & CASE hashes WHEN 0 THEN 0 WHEN 1 THEN f0 WHEN 2 THEN f0 & f1 ELSE f0 & f1 & f2 & f3 END) AS decoded FROM d0),
decodes AS (SELECT config, nbits, family, doc_id, source, attack, key, decoded, nbits - bit_count(xor(key, decoded))::INTEGER AS matches, (nbits - bit_count(xor(key, decoded))::INTEGER) / nbits AS bit_acc FROM d1)
"""


def blind_trials(spark: SparkSession, d: str) -> DataFrame:
    """(config, nbits, doc_id, source, trial, matches): unmarked decodes against the own key (trial 0) and random keys."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("missing")).alias("source"))
    configs = F.explode(F.array(*[F.struct(F.lit(n).alias("config"), F.lit(b).alias("nbits")) for n, b, _ in CONFIGS]))
    r = docs.withColumn("c", configs).select("doc_id", "source", "c.*")
    mask = F.expr("shiftleft(cast(1 as bigint), nbits)") - 1
    r = r.withColumn("blind", md5_word(F.lit("blind"), F.col("config"), F.col("doc_id").cast("string")).bitwiseAND(mask))
    r = r.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(RANDOM_KEYS))))
    own = md5_word(F.lit("key"), F.col("config"), F.col("doc_id").cast("string"))
    other = md5_word(F.lit("random"), F.col("config"), F.col("trial").cast("string"))
    key = F.when(F.col("trial") == 0, own).otherwise(other).bitwiseAND(mask)
    return r.withColumn("matches", F.col("nbits") - F.bit_count(F.col("blind").bitwiseXOR(key))).drop("blind")


TRIALS_SQL = f"""
cfg(config, nbits, family) AS (VALUES {', '.join(f"('{n}', {b}, '{f}')" for n, b, f in CONFIGS)}),
tr AS (SELECT unnest(range({RANDOM_KEYS + 1})) AS trial),
b0 AS (SELECT config, nbits, doc_id, coalesce(source, 'missing') AS source, {sql_word("'blind'", 'config', 'doc_id')} & ((1::BIGINT << nbits) - 1) AS blind, {sql_word("'key'", 'config', 'doc_id')} & ((1::BIGINT << nbits) - 1) AS own FROM documents, cfg),
rk AS (SELECT config, trial, {sql_word("'random'", 'config', 'trial')} & ((1::BIGINT << nbits) - 1) AS rkey FROM cfg, tr),
trials AS (SELECT b0.config, nbits, doc_id, source, trial, nbits - bit_count(xor(blind, CASE WHEN trial = 0 THEN own ELSE rkey END))::INTEGER AS matches FROM b0 JOIN rk ON rk.config = b0.config)
"""


def method_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def negative_records(spark: SparkSession, d: str) -> DataFrame:
    """(rec_id, method, source_id, attack, cal, top1, scores): distinct records with a finite score, methods as in the methods table."""
    names = table(spark, d, "methods").select(method_key(F.col("method")).alias("k"), "method")
    ok = F.filter("scores", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    r = table(spark, d, "perquery_neg").where(F.col("rec_id").isNotNull()).select("rec_id", method_key(F.col("method")).alias("k"), "source_id", "attack", "cal", F.transform(ok, lambda x: x.cast("double")).alias("scores"))
    r = r.where(F.size("scores") > 0).dropDuplicates(["rec_id"])
    return r.join(names, "k").select("rec_id", "method", "source_id", "attack", "cal", F.array_max("scores").alias("top1"), "scores")


RECORDS_SQL = r"""
mk AS (SELECT lower(trim(method)) AS k, method FROM methods),
pq AS (SELECT rec_id, lower(trim(method)) AS k, source_id, attack, cal, list_transform(list_filter(scores, lambda x: x IS NOT NULL AND isfinite(x)), lambda x: x::DOUBLE) AS scores FROM perquery_neg WHERE rec_id IS NOT NULL),
rec AS (SELECT DISTINCT ON (rec_id) rec_id, mk.method, source_id, attack, cal, list_max(scores) AS top1, scores FROM pq JOIN mk USING (k) WHERE len(scores) > 0)
"""
