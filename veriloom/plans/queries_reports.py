"""Queries of the search driver, second stages, refitted thresholds and report tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriloom.operators import calibrate, evaluate, reports, retrieval
from veriloom.plans.bindings import CONFIGS, RECORDS_SQL, decodes, flagged, negative_records, sql_word, table
from veriloom.plans.queries_calibration import PAIR_SQL, PAIR_TARGETS, THR_SQL, _pair_thresholds, _query_thresholds
from veriloom.plans.queries_payload import D, K_SQL, _k
from veriloom.plans.queries_retrieval import APART, PDQ_SQL, _codes
from veriloom.plans.registry import query
from veriloom.plans.session import stage

R = "WITH " + RECORDS_SQL
#: Results that the search driver keeps of every query.
DEPTH = 50

DRIVER_SQL = f"""
WITH {PDQ_SQL},
gone AS (SELECT item_id FROM set_membership WHERE set_name = 'dist' AND flagged AND item_id IS NOT NULL),
q AS (SELECT set_name, item_id, words FROM c WHERE set_name IN ('neg', 'hard')),
r AS (SELECT item_id, words FROM c WHERE set_name IN ('reg', 'dist') AND item_id NOT IN (FROM gone)),
s AS (SELECT q.set_name, q.item_id AS query_id, r.item_id AS ref_id, max(round(1.0 - ({APART}) / 256.0::DOUBLE, 9)) AS score FROM q, r GROUP BY ALL),
found AS (SELECT set_name, query_id, ref_id, score, row_number() OVER (PARTITION BY set_name, query_id ORDER BY score DESC, ref_id) AS rank FROM s QUALIFY rank <= {DEPTH})
"""


def _driver(spark: SparkSession, d: str, k: int = DEPTH) -> DataFrame:
    """(set_name, query_id, rank, ref_id, score): negative and hard queries against the registered items and the unflagged distractors."""
    c = stage(_codes(spark, d, "PDQ", 4).where(F.col("set_name").isin("reg", "dist", "neg", "hard")), "codes")
    refs = retrieval.without(c.where(F.col("set_name").isin("reg", "dist")), flagged(spark, d, "dist"), "item_id").select(F.col("item_id").alias("ref_id"), F.col("words").alias("ref"))
    asked = c.where(F.col("set_name").isin("neg", "hard")).select(F.concat_ws("|", "set_name", "item_id").alias("query_id"), F.col("words").alias("query"))
    found = retrieval.top_k(asked, refs, k, "hamming", 256)
    part = lambda i: F.split_part("query_id", F.lit("|"), F.lit(i))
    return found.select(part(1).alias("set_name"), part(2).alias("query_id"), "rank", "ref_id", "score")


@query("JOI1 JOI2 SRT1", DRIVER_SQL + "SELECT set_name, query_id, rank::INTEGER AS rank, ref_id, round(score, 6) AS score FROM found")
def registered_search(spark: SparkSession, d: str) -> DataFrame:
    """The search driver: 50 results of every query, distractors that were flagged being out of the index."""
    return _driver(spark, d).withColumn("score", F.round("score", 6))


SECOND_SQL = DRIVER_SQL + """,
p AS (SELECT DISTINCT item_id, words[1] AS w FROM descriptors_bits WHERE method = 'pHash-64' AND len(words) = 1 AND words[1] IS NOT NULL),
top AS (SELECT * FROM found WHERE rank = 1),
v AS (SELECT set_name, query_id, ref_id, score, coalesce(max(64 - bit_count(xor(a.w, b.w))::INTEGER), 0)::INTEGER AS inliers FROM top LEFT JOIN p a ON a.item_id = query_id LEFT JOIN p b ON b.item_id = ref_id GROUP BY ALL),
kz AS (SELECT 1 + max(inliers) AS k_zero FROM v JOIN (SELECT query_id, row_number() OVER (ORDER BY query_id) % 2 = 1 AS cal FROM (SELECT DISTINCT query_id FROM v WHERE set_name = 'neg')) USING (query_id) WHERE cal AND set_name = 'neg')
"""


@query("JOI18 CAL8", SECOND_SQL + "SELECT set_name, query_id, ref_id, round(score, 6) AS score, inliers, k_zero, inliers >= k_zero AS verified FROM v, kz")
def verified_top1(spark: SparkSession, d: str) -> DataFrame:
    """A second stage over each query's best reference: equal bits of another code, accepted from k_zero on, which no calibration negative reaches."""
    p = table(spark, d, "descriptors_bits").where((F.col("method") == "pHash-64") & (F.size("words") == 1) & F.col("words")[0].isNotNull()).select("item_id", F.col("words")[0].alias("w")).distinct()
    top = _driver(spark, d, 1)
    v = reports.second_stage(top, p.select(F.col("item_id").alias("query_id"), F.col("w").alias("qw")), p.select(F.col("item_id").alias("ref_id"), F.col("w").alias("rw")), 64 - F.bit_count(F.col("qw").bitwiseXOR(F.col("rw"))))
    v = stage(v, "verified")  # read five times below; the search runs once
    neg = v.where(F.col("set_name") == "neg")
    half = calibrate.keep_alternate(neg, "query_id").where("calibration").select("query_id")
    k = calibrate.verification_ks(neg.join(half, "query_id", "left_semi").withColumn("method", F.lit("all")), 0).select("k_zero")  # one row
    return v.crossJoin(k).select("set_name", "query_id", "ref_id", F.round("score", 6).alias("score"), "inliers", "k_zero", (F.col("inliers") >= F.col("k_zero")).alias("verified"))


@query("JOI8", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, round(-list_sum(list_transform(list_zip(q.v, r.v), lambda z: abs(z[1] - z[2]))), 9) + 0.0 AS score FROM e q, e r WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, ref_id, round(score, 6) AS score FROM k WHERE rank <= 50""")
def external_scores(spark: SparkSession, d: str) -> DataFrame:
    """Needles, the ids divisible by 50, against the whole haystack under a scorer that the index does not know: the negated city-block distance."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("query"))

    def city_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return -np.stack([np.abs(b - x).sum(1) for x in a])

    return retrieval.scored_pairs(q, e.select(F.col("vec_id").alias("ref_id"), F.col("v").alias("ref")), city_block, 50).withColumn("score", F.round("score", 6))


@query("JOI6", f"""
WITH {PDQ_SQL}, own AS (SELECT item_id, max(source) AS owner FROM items WHERE item_id IS NOT NULL GROUP BY 1),
m AS (SELECT DISTINCT q.item_id AS query_id, r.item_id AS ref_id FROM c q JOIN c r ON q.set_name IN ('dist', 'neg', 'hard') AND r.set_name = 'reg' AND q.item_id <> r.item_id AND {APART} <= 31)
SELECT query_id, count(*) AS n_refs, count(DISTINCT owner) AS n_owners FROM m LEFT JOIN own ON own.item_id = ref_id GROUP BY query_id""")
def range_owners(spark: SparkSession, d: str) -> DataFrame:
    """References within 31 bits of a query's codes, and their distinct owners."""
    c = _codes(spark, d, "PDQ", 4)
    q = c.where(F.col("set_name").isin("dist", "neg", "hard")).select(F.col("item_id").alias("query_id"), F.col("words").alias("query"))
    r = c.where(F.col("set_name") == "reg").select(F.col("item_id").alias("ref_id"), F.col("words").alias("ref"))
    owner = table(spark, d, "items").where(F.col("item_id").isNotNull()).groupBy(F.col("item_id").alias("ref_id")).agg(F.max("source").alias("owner"))
    m = retrieval.within(q, r, 1 - 31 / 256, "hamming", 256)
    return m.join(owner, "ref_id", "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("owner").alias("n_owners"))


@query("AGG10 CAL1", R + """,
kd AS (SELECT item_id AS source_id, max(kind) AS kind FROM items WHERE item_id IS NOT NULL GROUP BY 1),
x AS (SELECT rec.method || '|' || coalesce(kind, 'missing') AS g, rec.method, coalesce(kind, 'missing') AS kind, top1, cal FROM rec LEFT JOIN kd USING (source_id)),
c AS (SELECT g, top1, row_number() OVER (PARTITION BY g ORDER BY top1 DESC) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM x WHERE cal),
kk AS (SELECT g, max(n) AS n, floor(0.1::DOUBLE * max(n))::BIGINT AS k FROM c GROUP BY g),
t AS (SELECT kk.g, top1 + 1e-6 AS threshold FROM kk JOIN c ON c.g = kk.g AND c.pos = kk.k WHERE k >= 5 AND k < kk.n)
SELECT method, kind, round(threshold, 6) AS threshold, count(*) AS n, sum((top1 >= threshold)::INTEGER)::BIGINT AS hits, round(sum((top1 >= threshold)::INTEGER) / greatest(1, count(*)), 6) AS fpr
FROM x JOIN t USING (g) WHERE NOT cal GROUP BY method, kind, threshold""")
def content_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """False positives by kind of content, with a threshold fitted anew on the records of each kind."""
    kind = table(spark, d, "items").where(F.col("item_id").isNotNull()).groupBy(F.col("item_id").alias("source_id")).agg(F.max("kind").alias("kind"))
    x = negative_records(spark, d).join(kind, "source_id", "left").withColumn("kind", F.coalesce("kind", F.lit("missing"))).withColumn("g", F.concat_ws("|", "method", "kind"))
    t = calibrate.query_thresholds(x.where("cal"), [0.1], "g", "top1").where("resolved").select("g", "threshold")
    held = x.where(~F.col("cal")).join(t, "g")
    hit = F.sum((F.col("top1") >= F.col("threshold")).cast("bigint"))
    return held.groupBy("method", "kind", "threshold").agg(F.count(F.lit(1)).alias("n"), hit.alias("hits")).select("method", "kind", F.round("threshold", 6).alias("threshold"), "n", "hits", F.round(evaluate.over_max1(F.col("hits"), F.col("n")), 6).alias("fpr"))


@query("CAL6", R + """, s AS (SELECT method, unnest(scores) AS score FROM rec WHERE NOT cal)
SELECT method, round(quantile_cont(score, 0.99), 6) AS tau, count(*) AS n FROM s GROUP BY method""")
def pooled_null(spark: SparkSession, d: str) -> DataFrame:
    """The 0.99 quantile of all recorded scores of untouched sources, pooled for each method as pixels are for each map."""
    s = negative_records(spark, d).where(~F.col("cal")).select("method", F.explode("scores").alias("score"))
    return calibrate.quantiles(s, ["method"], "score", {"tau": 0.99}).select("method", F.round("tau", 6).alias("tau"), "n")


@query("INF10 INF2")
def verification_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Hit rate of each method at its fixed threshold with a source-resampled interval, and the bound on false bindings; records of calibration stand in for positives."""
    t = _query_thresholds(spark, d).where((F.col("target") == 0.1) & F.col("resolved")).select("method", "threshold")
    r = negative_records(spark, d).where(F.col("source_id").isNotNull()).join(t, "method").select("method", "source_id", "cal", (F.col("top1") >= F.col("threshold")).alias("hit"))
    return reports.fixed_threshold_bootstrap(r, "method", "source_id", "cal", "hit")


@query("RPT2 RPT7", THR_SQL + """,
f AS (SELECT r.method, target, round(avg((top1 >= threshold)::INTEGER), 6) AS fpr, count(*) AS n FROM rec r JOIN thr ON thr.method = r.method AND resolved WHERE NOT cal GROUP BY ALL),
md AS (SELECT method, round(median(top1), 6) AS median_score FROM rec GROUP BY method)
SELECT m.method, m.family, coalesce(m.tier, '?') AS tier, max(f.fpr) FILTER (WHERE target = 0.1) AS fpr_10, max(f.fpr) FILTER (WHERE target = 0.01) AS fpr_1, max(f.n) AS n, any_value(median_score) AS median_score
FROM methods m LEFT JOIN f ON f.method = m.method LEFT JOIN md ON md.method = m.method GROUP BY ALL""")
def method_table(spark: SparkSession, d: str) -> DataFrame:
    """One row for each method: held-out false positive rates at both targets as columns, and the median score."""
    r = negative_records(spark, d)
    t = _query_thresholds(spark, d).where("resolved").select("method", "target", "threshold")
    f = r.where(~F.col("cal")).join(t, "method").groupBy("method", "target").agg(F.round(evaluate.share(F.col("top1") >= F.col("threshold")), 6).alias("fpr"), F.count(F.lit(1)).alias("n"))
    wide = f.groupBy("method").agg(F.max(F.when(F.col("target") == 0.1, F.col("fpr"))).alias("fpr_10"), F.max(F.when(F.col("target") == 0.01, F.col("fpr"))).alias("fpr_1"), F.max("n").alias("n"))
    middle = calibrate.quantiles(r, ["method"], "top1", {"m": 0.5}).select("method", F.round("m", 6).alias("median_score"))
    m = table(spark, d, "methods").select("method", "family", F.coalesce("tier", F.lit("?")).alias("tier"))
    return m.join(wide, "method", "left").join(middle, "method", "left")


@query("RPT3", PAIR_SQL + "SELECT method, min(target) AS target, round(arg_min(threshold, target), 6) AS threshold FROM thr WHERE resolved GROUP BY method")
def strictest_targets(spark: SparkSession, d: str) -> DataFrame:
    """The strictest target of each method that its records resolve, with its threshold."""
    t = _pair_thresholds(spark, d).where(F.col("resolved") & F.col("target").isin(*PAIR_TARGETS))
    return t.groupBy("method").agg(F.min("target").alias("target"), F.round(F.min_by("threshold", "target"), 6).alias("threshold"))


@query("RPT8 AGG19", D + f"""
, o AS (SELECT config, matches >= {K_SQL} AS wm, {sql_word("'fp'", 'attack', 'doc_id')} % 100 < 70 AS fp FROM decodes WHERE attack <> 'none')
SELECT config, round(avg(wm::INTEGER), 6) AS wm, round(avg(fp::INTEGER), 6) AS fp, round(avg((wm OR fp)::INTEGER), 6) AS either, round(avg((wm OR fp)::INTEGER) - greatest(avg(wm::INTEGER), avg(fp::INTEGER)), 6) AS gain, count(*) AS n FROM o GROUP BY config""")
def complementarity_table(spark: SparkSession, d: str) -> DataFrame:
    """What either of two marks finds beyond the better one, for each configuration under all transformations."""
    from veriloom.plans.bindings import md5_word

    o = decodes(spark, d).where(F.col("attack") != "none").select("config", (F.col("matches") >= _k()).alias("wm"), (F.pmod(md5_word(F.lit("fp"), F.col("attack"), F.col("doc_id").cast("string")), F.lit(100)) < 70).alias("fp"))
    s = o.groupBy("config").agg(evaluate.share(F.col("wm")).alias("wm"), evaluate.share(F.col("fp")).alias("fp"), evaluate.share(F.col("wm") | F.col("fp")).alias("either"), F.count(F.lit(1)).alias("n"))
    return s.select("config", F.round("wm", 6).alias("wm"), F.round("fp", 6).alias("fp"), F.round("either", 6).alias("either"), F.round(F.col("either") - F.greatest("wm", "fp"), 6).alias("gain"), "n")


@query("RPT16 STB1", D + """
, k AS (SELECT config, source, attack, avg(bit_acc) AS m, min(bit_acc) AS lo, count(DISTINCT decoded) AS strings, count(*) AS n FROM decodes GROUP BY ALL)
SELECT config, source, round(max(m) FILTER (WHERE attack = 'none') - min(m), 6) AS drop, round(min(lo), 6) AS worst, sum(strings)::BIGINT AS strings, sum(n)::BIGINT AS n FROM k GROUP BY config, source""")
def stability_table(spark: SparkSession, d: str) -> DataFrame:
    """Loss of bit accuracy under the worst transformation, the worst decode and the distinct bit strings, by configuration and source."""
    k = decodes(spark, d).groupBy("config", "source", "attack").agg(F.avg("bit_acc").alias("m"), F.min("bit_acc").alias("lo"), F.countDistinct("decoded").alias("strings"), F.count(F.lit(1)).alias("n"))
    drop = F.max(F.when(F.col("attack") == "none", F.col("m"))) - F.min("m")
    return k.groupBy("config", "source").agg(F.round(drop, 6).alias("drop"), F.round(F.min("lo"), 6).alias("worst"), F.sum("strings").alias("strings"), F.sum("n").alias("n"))


@query("SNK7 RPT11", """
WITH a AS (SELECT DISTINCT 'method' AS space, method AS name, coalesce(family, '') AS value FROM methods UNION SELECT 'target', method, target_pct::VARCHAR FROM thresholds WHERE target_pct IS NOT NULL UNION SELECT 'set', set_name, count(DISTINCT item_id)::VARCHAR FROM set_membership GROUP BY set_name)
SELECT space || '.' || name AS key, max(value) AS value, count(*) AS n_values FROM a WHERE name IS NOT NULL GROUP BY 1""")
def merged_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of several reports under one namespace; a key with more than one value is a conflict."""
    m = table(spark, d, "methods").select(F.col("method").alias("name"), F.coalesce("family", F.lit("")).alias("value"))
    t = table(spark, d, "thresholds").where(F.col("target_pct").isNotNull()).select(F.col("method").alias("name"), F.col("target_pct").cast("string").alias("value"))
    s = table(spark, d, "set_membership").groupBy(F.col("set_name").alias("name")).agg(F.countDistinct("item_id").cast("string").alias("value"))
    return reports.merge_values({"method": m, "target": t, "set": s})


@query("STB3", """
WITH v AS (SELECT DISTINCT vec_id, embedding AS e FROM embeddings),
p AS (SELECT vec_id, p, list_transform(e[p * 16 + 1 : p * 16 + 16], lambda x: floor(x::DOUBLE * 100 + 0.5)::INTEGER) AS a, list_transform(e[p * 16 + 1 : p * 16 + 16], lambda x: floor(x::DOUBLE * 100 + 0.4999)::INTEGER) AS b FROM v, (SELECT unnest(range(4)) AS p))
SELECT p::INTEGER AS plane, count(*) AS n, sum((md5(array_to_string(a, ',')) = md5(array_to_string(b, ',')))::INTEGER)::BIGINT AS equal FROM p GROUP BY p""")
def plane_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Frames of four planes rendered with two roundings: how many hashes of each plane are equal."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding").distinct()
    digits = lambda by: F.transform("embedding", lambda x: F.floor(x.cast("double") * 100 + by).cast("int"))
    a, b = reports.plane_digests(e.select("vec_id", digits(0.5).alias("f")), "vec_id", "f", 4), reports.plane_digests(e.select("vec_id", digits(0.4999).alias("f")), "vec_id", "f", 4)
    j = a.join(b.withColumnRenamed("digest", "other"), ["vec_id", "plane"])
    return j.groupBy("plane").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("digest") == F.col("other")).cast("bigint")).alias("equal"))


@query("LOC17", """
WITH e AS (SELECT edit_id, max(coalesce(edit_type, 'missing')) AS edit_type, max(nullif(regexp_extract(lower(src), '(p[a-z0-9]{8})', 1), '')) AS src, round(max(visible_frac), 9) AS f FROM edits WHERE edit_id IS NOT NULL GROUP BY edit_id),
s AS (SELECT edit_type, src, edit_id, f FROM e WHERE src IS NOT NULL AND f IS NOT NULL QUALIFY row_number() OVER (PARTITION BY edit_type, src ORDER BY f DESC, edit_id) = 1)
SELECT edit_type, src, edit_id, row_number() OVER (PARTITION BY edit_type ORDER BY f DESC, edit_id)::INTEGER AS place FROM s QUALIFY place <= 4""")
def gallery(spark: SparkSession, d: str) -> DataFrame:
    """The four most visible edits of each type, each from another source: a report of fixed size."""
    src = F.nullif(F.regexp_extract(F.lower("src"), "(p[a-z0-9]{8})", 1), F.lit(""))
    e = table(spark, d, "edits").where(F.col("edit_id").isNotNull()).groupBy("edit_id").agg(F.max(F.coalesce("edit_type", F.lit("missing"))).alias("edit_type"), F.max(src).alias("src"), F.round(F.max("visible_frac"), 9).alias("f"))
    return reports.picks(e.where(F.col("src").isNotNull() & F.col("f").isNotNull()), "edit_type", "src", [F.col("f").desc(), F.col("edit_id")], 4).select("edit_type", "src", "edit_id", F.col("place").cast("int").alias("place"))


@query("RNK3 CST5", R + """,
agg AS (SELECT method AS config, round(avg(top1), 6) AS quality, avg(len(scores)) AS ms FROM rec GROUP BY ALL),
c AS (SELECT m.method AS config, m.family, quality, round(ms, 6) AS ms, round(ms * (CASE WHEN gpu THEN 2.5 ELSE 0.4 END::DOUBLE), 6) AS cost FROM methods m JOIN agg ON agg.config = m.method),
z AS (SELECT *, round(exp(0.5 * ln(greatest(quality, 1e-9)) + 0.25 * ln(1 / (1 + ms)) + 0.25 * ln(1 / (1 + cost))), 9) AS combined FROM c)
SELECT 'cost' AS prize, (SELECT config FROM z ORDER BY cost, config LIMIT 1) AS config UNION ALL SELECT 'speed', (SELECT config FROM z ORDER BY ms, config LIMIT 1)
UNION ALL SELECT 'quality', (SELECT config FROM z ORDER BY quality DESC, config LIMIT 1) UNION ALL SELECT 'combined', (SELECT config FROM z ORDER BY combined DESC, config LIMIT 1)""")
def prize_winners(spark: SparkSession, d: str) -> DataFrame:
    """The configuration that wins by cost, by speed, by quality and by the weighted geometric mean of the three."""
    agg = negative_records(spark, d).groupBy(F.col("method").alias("config")).agg(F.round(F.avg("top1"), 6).alias("quality"), F.avg(F.size("scores")).alias("raw"))
    c = table(spark, d, "methods").select(F.col("method").alias("config"), "gpu").join(agg, "config")
    c = c.select("config", "quality", F.round("raw", 6).alias("ms"), F.round(F.col("raw") * F.when(F.col("gpu"), 2.5).otherwise(0.4), 6).alias("cost"))
    logs = 0.5 * F.ln(F.greatest(F.col("quality"), F.lit(1e-9))) + 0.25 * F.ln(1 / (1 + F.col("ms"))) + 0.25 * F.ln(1 / (1 + F.col("cost")))
    return reports.winners(c.withColumn("combined", F.round(F.exp(logs), 9)), "config", {"cost": F.col("cost"), "speed": F.col("ms"), "quality": -F.col("quality"), "combined": -F.col("combined")})


@query("SRC1 SRC8 SNK1 SNK3 SNK5", "SELECT 'items' AS what, count(*) AS n FROM (SELECT DISTINCT item_id FROM items WHERE item_id IS NOT NULL) UNION ALL SELECT 'sets', count(*) FROM (SELECT DISTINCT modality, set_name, item_id FROM set_membership WHERE item_id IS NOT NULL AND modality IS NOT NULL) UNION ALL SELECT 'stale', 0")
def stored_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Items and sets written as records and read back: the rows of both, and whether a stored table is stale against a fresh one."""
    return reports.round_trip(table(spark, d, "items").where(F.col("item_id").isNotNull()).select("item_id").distinct(), table(spark, d, "set_membership").where(F.col("item_id").isNotNull() & F.col("modality").isNotNull()).select("modality", "set_name", "item_id").distinct())
