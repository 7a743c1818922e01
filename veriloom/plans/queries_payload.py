"""Queries on payload decodes, gates, ranking, cost and determinism."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriloom.operators import calibrate, evaluate, payload
from veriloom.plans.bindings import CONFIGS, DECODES_SQL, RECORDS_SQL, TRIALS_SQL, blind_trials, decodes, md5_word, negative_records, sql_word, table
from veriloom.plans.registry import query

D, T, R = "WITH " + DECODES_SQL, "WITH " + TRIALS_SQL, "WITH " + RECORDS_SQL

#: k of n at 1e-6, written out for the SQL side: the widths of the payload configurations.
K_SQL = "CASE nbits WHEN 32 THEN 30 WHEN 48 THEN 41 WHEN 60 THEN 49 END"


def _k() -> Column:
    from veriloom.functions.stats import k_of_n

    k = F.lit(None).cast("int")
    for _, n, _ in CONFIGS:
        k = F.when(F.col("nbits") == n, k_of_n(n)).otherwise(k)
    return k


@query("PAY2 PAY3 PAY7", D + f"""
SELECT config, attack, count(*) AS n, round(avg(bit_acc), 6) AS bit_acc_mean, round(min(bit_acc), 6) AS bit_acc_min, round(avg((matches >= {K_SQL})::INTEGER), 6) AS key_detect_rate, round(avg((matches = nbits)::INTEGER), 6) AS exact_rate FROM decodes GROUP BY ALL""")
def bit_accuracy_by_attack(spark: SparkSession, d: str) -> DataFrame:
    r = decodes(spark, d).withColumn("native_detect", F.lit(None).cast("boolean")).withColumn("payload_exact", F.lit(None).cast("boolean"))
    b = payload.attack_block(r, _k(), "doc_id")
    return b.select("config", "attack", "n", *[F.round(c, 6).alias(c) for c in ("bit_acc_mean", "bit_acc_min", "key_detect_rate", "exact_rate")])


@query("PAY8 RPT14", D + "SELECT config, round(avg((matches = nbits)::INTEGER), 6) AS exact_mean FROM decodes WHERE attack <> 'none' GROUP BY config")
def exact_recovery(spark: SparkSession, d: str) -> DataFrame:
    return decodes(spark, d).where(F.col("attack") != "none").groupBy("config").agg(F.round(evaluate.share(F.col("matches") == F.col("nbits")), 6).alias("exact_mean"))


@query("PAY5 PAY6 PAY9 PAY10 PAY12", T + f"""
SELECT config, count(*) AS n_trials, sum((matches >= {K_SQL})::INTEGER)::BIGINT AS hits, max(matches) AS max_matches, round(avg(matches), 6) AS mean_matches,
  sum((matches >= {K_SQL} AND trial = 0)::INTEGER)::BIGINT AS own_hits, sum((matches >= {K_SQL} AND trial > 0)::INTEGER)::BIGINT AS random_hits FROM trials GROUP BY config""")
def key_false_match(spark: SparkSession, d: str) -> DataFrame:
    return payload.false_match_block(blind_trials(spark, d), _k(), ["config"]).withColumn("mean_matches", F.round("mean_matches", 6))


@query("PAY11", T + """,
s AS (SELECT config, source, bool_or(matches >= nbits / 2 + 2 * sqrt(nbits) / 2 + 3) AS h FROM trials GROUP BY ALL)
SELECT config, count(*) AS n_sources, sum(h::INTEGER)::BIGINT AS hit_sources FROM s GROUP BY config""")
def false_match_by_source(spark: SparkSession, d: str) -> DataFrame:
    hit = F.col("matches") >= F.col("nbits") / 2 + 2 * F.sqrt("nbits") / 2 + 3
    return payload.by_source(blind_trials(spark, d), hit, ["config"], "source")


@query("PAY4 INF8", """
WITH n AS (SELECT unnest([16, 32, 40, 64, 100, 256]) AS nbits),
i AS (SELECT nbits, unnest(range(0, nbits + 1)) AS i FROM n),
p AS (SELECT nbits, i, exp(lgamma(nbits + 1) - lgamma(i + 1) - lgamma(nbits - i + 1) - nbits * ln(2)) AS p FROM i),
t AS (SELECT nbits, i, sum(p) OVER (PARTITION BY nbits ORDER BY i DESC) AS tail FROM p)
SELECT nbits::BIGINT AS nbits, coalesce(min(i) FILTER (WHERE tail <= 1e-6 AND i >= nbits / 2), nbits + 1)::BIGINT AS k FROM t GROUP BY nbits""")
def k_of_n_threshold(spark: SparkSession, d: str) -> DataFrame:
    return payload.k_thresholds(spark.createDataFrame([(n,) for n in (16, 32, 40, 64, 100, 256)], "nbits bigint"))


@query("JOI17", T.replace("trials AS", "unused AS") + f"""
SELECT config, doc_id, max(nbits - bit_count(xor(blind, rkey))::INTEGER) AS best FROM b0 JOIN rk USING (config) WHERE trial > 0 GROUP BY ALL""")
def registered_key_max(spark: SparkSession, d: str) -> DataFrame:
    """Best agreement of every unmarked decode with any of the registered keys, of which there are fifty for each configuration."""
    return blind_trials(spark, d).where(F.col("trial") > 0).groupBy("config", "doc_id").agg(F.max("matches").alias("best"))


@query("AGG22", D + """,
k AS (SELECT DISTINCT config, doc_id, key & 4095 AS short FROM decodes),
c AS (SELECT *, count(*) OVER (PARTITION BY config, short) AS owners FROM k),
r AS (SELECT d.config, c.owners, d.matches = d.nbits AS exact FROM decodes d JOIN c USING (config, doc_id) WHERE attack = 'light')
SELECT config, count(*) AS n, sum((owners > 1)::INTEGER)::BIGINT AS shared, round(avg(exact::INTEGER) FILTER (WHERE owners = 1), 6) AS exact_unique FROM r GROUP BY config""")
def key_collisions(spark: SparkSession, d: str) -> DataFrame:
    r = decodes(spark, d).where(F.col("attack") == "light").withColumn("short", F.col("key").bitwiseAND(F.lit(4095)))
    owners = r.groupBy("config", "short").agg(F.count(F.lit(1)).alias("owners"))
    r = r.join(owners, ["config", "short"])
    exact = F.when(F.col("owners") == 1, (F.col("matches") == F.col("nbits")).cast("int"))
    return r.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("owners") > 1).cast("bigint")).alias("shared"), F.round(F.avg(exact), 6).alias("exact_unique"))


@query("PAY13", f"""
WITH f AS (SELECT doc_id, unnest(range(9)) AS frame FROM documents),
b AS (SELECT doc_id, frame, unnest(range(8)) AS bit FROM f),
l AS (SELECT doc_id, bit, frame, ({sql_word("'logit'", 'doc_id', 'bit', 'frame')} % 2001 - 900) / 1000.0 AS logit FROM b WHERE frame % 3 = 0),
m AS (SELECT doc_id, bit, (avg(logit) > 0)::INTEGER AS v FROM l GROUP BY ALL)
SELECT doc_id, sum(v << bit)::BIGINT AS payload FROM m GROUP BY doc_id""")
def frame_majority(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("frame")).withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(7))))
    f = f.withColumn("logit", (F.pmod(md5_word(F.lit("logit"), F.col("doc_id").cast("string"), F.col("bit").cast("string"), F.col("frame").cast("string")), F.lit(2001)) - 900) / 1000.0)
    m = payload.majority(f.withColumnRenamed("bit", "at"), ["doc_id", "at"], "logit")
    return m.groupBy("doc_id").agg(F.sum(F.expr("bit * cast(pow(2, at) as bigint)")).alias("payload"))


@query("AGG19 AGG21", D + f"""
, o AS (SELECT attack, matches >= {K_SQL} AS wm, {sql_word("'fp'", 'attack', 'doc_id')} % 100 < 70 AS fp FROM decodes)
SELECT coalesce(attack, '_all') AS attack, round(avg(wm::INTEGER), 6) AS wm, round(avg(fp::INTEGER), 6) AS fp, round(avg((wm OR fp)::INTEGER), 6) AS either, round(avg((wm AND fp)::INTEGER), 6) AS both,
  round(avg((wm AND NOT fp)::INTEGER), 6) AS wm_only, round(avg((fp AND NOT wm)::INTEGER), 6) AS fp_only, count(*) AS n FROM o GROUP BY GROUPING SETS ((attack), ())""")
def complementarity(spark: SparkSession, d: str) -> DataFrame:
    o = decodes(spark, d).select("attack", (F.col("matches") >= _k()).alias("wm"), (F.pmod(md5_word(F.lit("fp"), F.col("attack"), F.col("doc_id").cast("string")), F.lit(100)) < 70).alias("fp"))
    rate = lambda c, n: F.round(evaluate.share(c), 6).alias(n)
    wm, fp = F.col("wm"), F.col("fp")
    out = evaluate.by_stratum(o, ["attack"], rate(wm, "wm"), rate(fp, "fp"), rate(wm | fp, "either"), rate(wm & fp, "both"), rate(wm & ~fp, "wm_only"), rate(fp & ~wm, "fp_only"), F.count(F.lit(1)).alias("n"))
    return out.withColumnRenamed("level", "attack").drop("stratum")


# The table of configurations: each method with what its records and the methods table tell.
CONFIGS_SQL = R + """,
per AS (SELECT method AS config, attack AS set_name, count(*) AS n, sum((top1 >= 0.3)::INTEGER) AS hits FROM rec GROUP BY ALL),
agg AS (SELECT method AS config, round(avg(top1), 6) AS quality, round(median(len(scores)), 6) AS ms, round(avg((top1 >= 0.9)::INTEGER), 6) AS key_fpr, count(*) AS n_rec FROM rec GROUP BY ALL),
cfgs AS (SELECT m.method AS config, m.family, m.gpu, m.tier, m.dim, m.metric, quality, ms, key_fpr, n_rec, coalesce(regexp_matches(lower(code_licence), '^(mit|bsd|apache)'), false) AS deployable FROM methods m LEFT JOIN agg ON agg.config = m.method)
"""


def _configs(spark: SparkSession, d: str) -> DataFrame:
    r = negative_records(spark, d)
    agg = r.groupBy(F.col("method").alias("config")).agg(F.round(F.avg("top1"), 6).alias("quality"), F.round(evaluate.share(F.col("top1") >= 0.9), 6).alias("key_fpr"), F.count(F.lit(1)).alias("n_rec"))
    middle = calibrate.quantiles(r.select(F.col("method").alias("config"), F.size("scores").alias("depth")), ["config"], "depth", {"ms": 0.5})
    agg = agg.join(middle.select("config", F.round("ms", 6).alias("ms")), "config", "left").select("config", "quality", "ms", "key_fpr", "n_rec")
    m = table(spark, d, "methods").select(F.col("method").alias("config"), "family", "gpu", "tier", "dim", "metric", F.coalesce(F.lower("code_licence").rlike("^(mit|bsd|apache)"), F.lit(False)).alias("deployable"))
    return m.join(agg, "config", "left")


@query("GAT1 GAT2", CONFIGS_SQL + """,
g AS (SELECT config, sum(hits) / greatest(1, sum(n)) AS pooled, min(hits / greatest(1, n)) AS worst_set FROM per GROUP BY config)
SELECT c.config, round(pooled, 6) AS pooled, round(worst_set, 6) AS worst_set, coalesce(pooled >= 0.5 AND worst_set >= 0.5, false) AS robust, coalesce(key_fpr <= 0.05, false) AS fpr_ok,
  coalesce(pooled >= 0.5 AND worst_set >= 0.5, false) AND coalesce(key_fpr <= 0.05, false) AND deployable AS eligible FROM cfgs c LEFT JOIN g USING (config)""")
def gate_worst_set(spark: SparkSession, d: str) -> DataFrame:
    r = negative_records(spark, d)
    per = r.groupBy(F.col("method").alias("config"), F.col("attack").alias("set_name")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("top1") >= 0.3).cast("int")).alias("hits"))
    metas = _configs(spark, d).withColumn("native_fpr", F.lit(None).cast("double")).withColumn("errors", F.lit(0))
    return payload.gate(per, metas, robust=0.5, fpr_limit=0.05).select("config", F.round("pooled", 6).alias("pooled"), F.round("worst_set", 6).alias("worst_set"), "robust", "fpr_ok", "eligible")


@query("RNK1 SRT3", CONFIGS_SQL + """,
r AS (SELECT *, row_number() OVER (ORDER BY quality NULLS LAST, config) AS rank_first, row_number() OVER (ORDER BY key_fpr NULLS LAST, config) AS rank_second FROM cfgs)
SELECT config, rank_first::INTEGER AS rank_first, rank_second::INTEGER AS rank_second, (rank_first + rank_second)::INTEGER AS rank_total, row_number() OVER (ORDER BY rank_first + rank_second, n_rec DESC NULLS LAST, config)::INTEGER AS place FROM r""")
def rank_sum(spark: SparkSession, d: str) -> DataFrame:
    return payload.rank_sum(_configs(spark, d), "quality", "key_fpr", "n_rec").select("config", "rank_first", "rank_second", "rank_total", "place")


@query("RNK2", CONFIGS_SQL + """,
r AS (SELECT *, row_number() OVER (ORDER BY quality NULLS LAST, config) AS a, row_number() OVER (ORDER BY key_fpr NULLS LAST, config) AS b FROM cfgs),
p AS (SELECT config, family, row_number() OVER (ORDER BY a + b, n_rec DESC NULLS LAST, config) AS place FROM r),
one AS (SELECT config, family FROM p WHERE place = 1)
SELECT 'default' AS role, config FROM one UNION ALL
SELECT 'runner_up', config FROM (SELECT p.config FROM p, one WHERE p.config <> one.config ORDER BY (p.family <> one.family) DESC, place LIMIT 1)""")
def default_and_runner_up(spark: SparkSession, d: str) -> DataFrame:
    return payload.runner_up(payload.rank_sum(_configs(spark, d), "quality", "key_fpr", "n_rec"))


@query("RNK3", CONFIGS_SQL + """
SELECT tier, arg_min(config, (round(ms, 12), -quality, config)) AS fastest, arg_max(config, (quality, config)) AS best FROM cfgs WHERE quality IS NOT NULL GROUP BY tier""")
def winners(spark: SparkSession, d: str) -> DataFrame:
    c = _configs(spark, d).where(F.col("quality").isNotNull())
    return c.groupBy("tier").agg(F.min_by("config", F.struct(F.round("ms", 12), -F.col("quality"), F.col("config"))).alias("fastest"), F.max_by("config", F.struct("quality", "config")).alias("best"))


@query("CST2 CST3", CONFIGS_SQL + """,
x AS (SELECT config, tier, CASE WHEN gpu THEN NULL ELSE ms END AS ms FROM cfgs)
SELECT config, round(coalesce(ms, median(ms) OVER (PARTITION BY tier)), 6) AS ms, round(median(ms) OVER (PARTITION BY tier), 6) AS pooled_ms FROM x""")
def latency_pooling(spark: SparkSession, d: str) -> DataFrame:
    c = _configs(spark, d).select("config", "tier", F.when(F.col("gpu"), F.lit(None).cast("double")).otherwise(F.col("ms")).alias("ms"))
    pooled = F.median("ms").over(Window.partitionBy("tier"))
    c = c.withColumn("pooled_ms", F.round(pooled, 6))
    return payload.impute_by_group(c, "tier", "ms").select("config", F.round("ms", 6).alias("ms"), "pooled_ms")


@query("CST1 CST4 AGG26 SEC7", CONFIGS_SQL + """
SELECT config, round(ms * 1000 / 3600000.0 * 1.006, 9) AS usd_gpu, round(ms * 1000 / 3600000.0 * 0.34 / 8, 9) AS usd_cpu, round(least(ms * 1000 / 3600000.0 * 1.006, ms * 1000 / 3600000.0 * 0.34 / 8), 9) AS usd,
  round(1000 / ms / (1920 * 1080 / 1e6), 6) AS fps, round(ms * n_rec / 3600000.0, 9) AS hours FROM cfgs""")
def cost_per_unit(spark: SparkSession, d: str) -> DataFrame:
    gpu, cpu = payload.usd_per_unit(F.col("ms"), 1000, 1.006), payload.usd_per_unit(F.col("ms"), 1000, 0.34, 1 / 8)
    return _configs(spark, d).select("config", F.round(gpu, 9).alias("usd_gpu"), F.round(cpu, 9).alias("usd_cpu"), F.round(F.least(gpu, cpu), 9).alias("usd"), F.round(1000 / F.col("ms") / (1920 * 1080 / 1e6), 6).alias("fps"), F.round(F.col("ms") * F.col("n_rec") / 3_600_000.0, 9).alias("hours"))


@query("CST5", CONFIGS_SQL + """,
x AS (SELECT config, greatest(quality, 0) AS q, (quality - 0.5) / nullif(max(quality) OVER () - 0.5, 0) AS rel, min(ms) OVER () / ms AS speed FROM cfgs)
SELECT config, round(CASE WHEN q IS NOT NULL AND rel IS NOT NULL AND speed IS NOT NULL THEN exp((0.5 * ln(greatest(q, 1e-9)) + 0.3 * ln(greatest(rel, 1e-9)) + 0.2 * ln(greatest(speed, 1e-9))) / 1.0) END, 6) AS combined FROM x""")
def combined_score(spark: SparkSession, d: str) -> DataFrame:
    whole = Window.partitionBy(F.lit(0))  # one row for each method
    c = _configs(spark, d).select("config", F.when(F.col("quality").isNotNull(), F.greatest("quality", F.lit(0.0))).alias("q"), ((F.col("quality") - 0.5) / F.nullif(F.max("quality").over(whole) - 0.5, F.lit(0.0))).alias("rel"), (F.min("ms").over(whole) / F.col("ms")).alias("speed"))
    return payload.combined_score(c, {"q": 0.5, "rel": 0.3, "speed": 0.2}).select("config", F.round("combined", 6).alias("combined"))


@query("QLT1", """
SELECT l_returnflag, round(-10 * log10(avg(l_discount * l_discount)), 6) AS psnr, round(10 * log10(greatest(sum(l_quantity * l_quantity), 1e-12) / greatest(sum(l_tax * l_tax), 1e-12)), 6) AS snr FROM lineitem GROUP BY l_returnflag""")
def quality_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Closed-form quality: l_discount stands for an error, l_quantity for a signal and l_tax for its noise."""
    a = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg(F.col("l_discount") ** 2).alias("mse"), F.sum(F.col("l_quantity") ** 2).alias("s"), F.sum(F.col("l_tax") ** 2).alias("n"))
    return a.select("l_returnflag", F.round(payload.psnr(F.col("mse")), 6).alias("psnr"), F.round(payload.snr(F.col("s"), F.col("n")), 6).alias("snr"))


@query("QLT3", CONFIGS_SQL + "SELECT family, count(*) AS n_configs, round(avg(quality), 6) AS quality, round(avg(key_fpr), 6) AS key_fpr, round(median(ms), 6) AS ms, sum(deployable::INTEGER)::BIGINT AS deployable FROM cfgs GROUP BY family")
def config_summary(spark: SparkSession, d: str) -> DataFrame:
    return _configs(spark, d).groupBy("family").agg(F.count(F.lit(1)).alias("n_configs"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("key_fpr"), 6).alias("key_fpr"), F.round(F.median("ms"), 6).alias("ms"), F.sum(F.col("deployable").cast("bigint")).alias("deployable"))


@query("AGG24 STB1 STB3 JOI16", """
WITH c AS (SELECT DISTINCT item_id, variant, words FROM descriptors_bits WHERE method = 'PDQ' AND len(words) = 4 AND len(list_filter(words, lambda x: x IS NULL)) = 0),
p AS (SELECT a.variant AS v1, b.variant AS v2, bit_count(xor(a.words[1], b.words[1]))::INTEGER + bit_count(xor(a.words[2], b.words[2]))::INTEGER + bit_count(xor(a.words[3], b.words[3]))::INTEGER + bit_count(xor(a.words[4], b.words[4]))::INTEGER AS apart FROM c a JOIN c b ON a.item_id = b.item_id AND a.variant < b.variant)
SELECT v1, v2, round(avg((apart = 0)::INTEGER), 6) AS identical, round(avg(apart), 6) AS mean_bits, max(apart) AS max_bits, count(*) AS n FROM p GROUP BY ALL""")
def cross_host_stability(spark: SparkSession, d: str) -> DataFrame:
    """Stored codes of one item under two variants, standing for two hosts."""
    t = table(spark, d, "descriptors_bits").where((F.col("method") == "PDQ") & (F.size("words") == 4) & ~F.exists("words", lambda x: x.isNull())).select("item_id", "variant", "words").distinct()
    a, b = t.select("item_id", F.col("variant").alias("v1"), F.col("words").alias("w1")), t.select("item_id", F.col("variant").alias("v2"), F.col("words").alias("w2"))
    apart = sum((F.bit_count(F.col("w1")[i].bitwiseXOR(F.col("w2")[i])) for i in range(1, 4)), F.bit_count(F.col("w1")[0].bitwiseXOR(F.col("w2")[0])))
    p = a.join(b, "item_id").where(F.col("v1") < F.col("v2")).withColumn("apart", apart)
    return p.groupBy("v1", "v2").agg(F.round(evaluate.share(F.col("apart") == 0), 6).alias("identical"), F.round(F.avg("apart"), 6).alias("mean_bits"), F.max("apart").alias("max_bits"), F.count(F.lit(1)).alias("n"))


@query("STB2 STB4", D + """,
h AS (SELECT attack, config, doc_id % 2 AS input_host, decoded FROM decodes)
SELECT attack, config, count(DISTINCT decoded) FILTER (WHERE input_host = 0) AS host_0, count(DISTINCT decoded) FILTER (WHERE input_host = 1) AS host_1 FROM h GROUP BY ALL""")
def host_grid(spark: SparkSession, d: str) -> DataFrame:
    """Distinct decodes by input host (the parity of the document) and transformation."""
    h = decodes(spark, d).withColumn("host", F.pmod(F.col("doc_id"), F.lit(2)))
    return h.groupBy("attack", "config").agg(F.countDistinct(F.when(F.col("host") == 0, F.col("decoded"))).alias("host_0"), F.countDistinct(F.when(F.col("host") == 1, F.col("decoded"))).alias("host_1"))


@query("AGG25", "SELECT n::BIGINT AS n, round(least(1.0::DOUBLE, n * 1e-6), 9) AS expected FROM (SELECT unnest([1, 10, 100, 1000, 10000, 100000, 1000000, 10000000]) AS n)")
def expected_false_bindings(spark: SparkSession, d: str) -> DataFrame:
    n = spark.range(8).select(F.pow(F.lit(10.0), "id").cast("bigint").alias("n"))
    return n.select("n", F.round(F.least(F.lit(1.0), F.col("n") * 1e-6), 9).alias("expected"))


@query("RPT12 RPT13 RPT15", CONFIGS_SQL + """
SELECT config, metric, quality, key_fpr, quality = max(quality) OVER (PARTITION BY metric) AS best, row_number() OVER (PARTITION BY family ORDER BY key_fpr NULLS LAST, config) = 1 AS family_row FROM cfgs""")
def config_table(spark: SparkSession, d: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("family").orderBy(F.col("key_fpr").asc_nulls_last(), "config")) == 1
    return _configs(spark, d).select("config", "metric", "quality", "key_fpr", (F.col("quality") == F.max("quality").over(Window.partitionBy("metric"))).alias("best"), first.alias("family_row"))


@query("PAY1 UDF1")
def payload_bits(spark: SparkSession, d: str) -> DataFrame:
    """Seeded payloads of all documents."""
    return payload.payload_bits(table(spark, d, "documents").select("doc_id"), "doc_id", 32).select("doc_id", F.array_join(F.transform("bits", lambda x: x.cast("string")), "").alias("bits"))


@query("PAY16 AGG21", f"""
WITH b AS (SELECT doc_id, {sql_word("'blind16'", 'doc_id')} & 65535 AS decoded, {sql_word("'detect'", 'doc_id')} % 10 < 3 AS det FROM documents),
r AS (SELECT DISTINCT {sql_word("'key16'", 'doc_id')} & 65535 AS decoded FROM documents)
SELECT count(*) AS n, sum(det::INTEGER)::BIGINT AS detected, sum((det AND r.decoded IS NOT NULL)::INTEGER)::BIGINT AS registered FROM b LEFT JOIN r USING (decoded)""")
def false_keys(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("k"))
    low = F.lit(65535)
    b = docs.select(md5_word(F.lit("blind16"), F.col("k")).bitwiseAND(low).alias("decoded"), (F.pmod(md5_word(F.lit("detect"), F.col("k")), F.lit(10)) < 3).alias("det"))
    return payload.false_keys(b, docs.select(md5_word(F.lit("key16"), F.col("k")).bitwiseAND(low).alias("decoded")), F.col("det"))
