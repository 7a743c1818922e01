"""Queries on similarity search, its evaluation and near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.operators import calibrate, evaluate, retrieval
from veriloom.plans.bindings import SEARCH_SQL, VECTOR_DIM, references, searched, table, usable_vectors, vector_queries
from veriloom.plans.registry import query
from veriloom.plans.session import stage

W = "WITH " + SEARCH_SQL


@query("JOI1 JOI2 JOI7 SIM2 PRJ1 PRJ2 SRT1", W + "SELECT query_id, rank::INTEGER AS rank, ref_id, round(score, 6) AS score FROM topk")
def topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return searched(spark, d).select("query_id", "rank", "ref_id", F.round("score", 6).alias("score"))


@query("JOI1 SIM3", r"""
WITH v0 AS (SELECT DISTINCT set_name, item_id, vec FROM descriptors_vec WHERE method = 'ColorMoment' AND len(vec) = 42 AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT set_name, item_id, vec::DOUBLE[42] AS v FROM v0),
s AS (SELECT q.item_id AS query_id, r.item_id AS ref_id, round(-array_distance(q.v, r.v), 9) + 0.0 AS score FROM v q, v r WHERE q.set_name IN ('hard', 'neg') AND r.set_name IN ('reg', 'dist')),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, ref_id, round(score, 6) AS score FROM k WHERE rank <= 10""")
def topk_l2(spark: SparkSession, d: str) -> DataFrame:
    v = usable_vectors(spark, d, "ColorMoment", 42, nonzero=False)
    q = v.where(F.col("set_name").isin("hard", "neg")).select(F.col("item_id").alias("query_id"), F.col("v").alias("query"))
    r = v.where(F.col("set_name").isin("reg", "dist")).select(F.col("item_id").alias("ref_id"), F.col("v").alias("ref"))
    return retrieval.top_k(q, r, 10, "l2", 42).withColumn("score", F.round("score", 6))


def _codes(spark: SparkSession, d: str, method: str, n_words: int) -> DataFrame:
    t = table(spark, d, "descriptors_bits").where((F.col("method") == method) & (F.size("words") == n_words) & ~F.exists("words", lambda x: x.isNull()))
    return t.select("set_name", "item_id", "variant", "words").distinct()


PDQ_SQL = "c AS (SELECT DISTINCT set_name, item_id, variant, words FROM descriptors_bits WHERE method = 'PDQ' AND len(words) = 4 AND len(list_filter(words, lambda x: x IS NULL)) = 0)"
APART = "bit_count(xor(q.words[1], r.words[1]))::INTEGER + bit_count(xor(q.words[2], r.words[2]))::INTEGER + bit_count(xor(q.words[3], r.words[3]))::INTEGER + bit_count(xor(q.words[4], r.words[4]))::INTEGER"


@query("JOI1 SIM1 SIM5 SIM6 SIM12", f"""
WITH {PDQ_SQL},
s AS (SELECT q.item_id AS query_id, r.item_id AS ref_id, max(round(1.0 - ({APART}) / 256.0::DOUBLE, 9)) AS score FROM c q, c r WHERE q.set_name IN ('hard', 'neg', 'dist') AND r.set_name = 'reg' GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, ref_id, round(score, 6) AS score FROM k WHERE rank <= 5""")
def variant_max_search(spark: SparkSession, d: str) -> DataFrame:
    c = _codes(spark, d, "PDQ", 4)
    q = c.where(F.col("set_name").isin("hard", "neg", "dist")).select(F.col("item_id").alias("query_id"), F.col("words").alias("query"))
    r = c.where(F.col("set_name") == "reg").select(F.col("item_id").alias("ref_id"), F.col("words").alias("ref"))
    return retrieval.top_k(q, r, 5, "hamming", 256).withColumn("score", F.round("score", 6))


@query("SIM4 JOI15", W + "SELECT q.query_id, q.source_id AS ref_id, round(list_dot_product(q.query, r.ref), 6) AS score FROM queries q JOIN refs r ON r.ref_id = q.source_id WHERE positive")
def true_pair_score(spark: SparkSession, d: str) -> DataFrame:
    q = vector_queries(spark, d).where("positive")
    truth = q.select("query_id", F.col("source_id").alias("ref_id"))
    return retrieval.true_scores(q.select("query_id", "query"), references(spark, d), truth).withColumn("score", F.round("score", 6))


def _top1(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, source_id, positive, attack, family, top1, hit, hit10): one row for each query, written once."""
    s = searched(spark, d)
    right = (F.col("ref_id") == F.col("source_id")) & F.col("positive")
    one = s.groupBy("query_id", "source_id", "positive", "attack", "family").agg(
        F.max("score").alias("top1"), F.max(((F.col("rank") == 1) & right).cast("int")).cast("boolean").alias("hit"), F.max(right.cast("int")).cast("boolean").alias("hit10"), F.max(F.when(F.col("rank") == 1, F.col("ref_id"))).alias("ref_id")
    )
    return stage(one, "top1")


TOP1_SQL = ",\none AS (SELECT query_id, source_id, positive, attack, family, max(score) AS top1, bool_or(rank = 1 AND ref_id = source_id AND positive) AS hit, bool_or(ref_id = source_id AND positive) AS hit10, max(CASE WHEN rank = 1 THEN ref_id END) AS ref_id FROM topk GROUP BY ALL)"


@query("AGG1 AGG12", W + TOP1_SQL + """
SELECT CASE WHEN grouping(attack) = 0 THEN 'attack' WHEN grouping(family) = 0 THEN 'family' ELSE '_all' END AS stratum, coalesce(CASE WHEN grouping(attack) = 0 THEN attack END, CASE WHEN grouping(family) = 0 THEN family END, '_all') AS level,
  round(avg(hit::INTEGER), 6) AS r1, round(avg(hit10::INTEGER), 6) AS r10, count(*) AS n FROM one WHERE positive GROUP BY GROUPING SETS ((attack), (family), ())""")
def recall_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    one = _top1(spark, d).where("positive")
    return evaluate.by_stratum(one, ["attack", "family"], F.round(evaluate.share(F.col("hit")), 6).alias("r1"), F.round(evaluate.share(F.col("hit10")), 6).alias("r10"), F.count(F.lit(1)).alias("n"))


@query("AGG12", W + TOP1_SQL + ", a AS (SELECT family, attack, avg(hit::INTEGER) AS r FROM one WHERE positive GROUP BY ALL) SELECT family, round(avg(r), 6) AS r1 FROM a GROUP BY family")
def family_mean_recall(spark: SparkSession, d: str) -> DataFrame:
    per = _top1(spark, d).where("positive").groupBy("family", "attack").agg(evaluate.share(F.col("hit")).alias("r"))
    return per.groupBy("family").agg(F.round(F.avg("r"), 6).alias("r1"))


@query("AGG13", W + TOP1_SQL + ", a AS (SELECT positive, attack, round(avg(top1), 6) AS m FROM one GROUP BY ALL) SELECT positive, attack, m FROM a QUALIFY row_number() OVER (PARTITION BY positive ORDER BY m DESC, attack) = 1")
def best_attack(spark: SparkSession, d: str) -> DataFrame:
    per = _top1(spark, d).groupBy("positive", "attack").agg(F.round(F.avg("top1"), 6).alias("m"))
    return evaluate.best_by(per, ["positive"], "m", "attack")


@query("AGG6", W + "SELECT q.attack, round(median(round(list_dot_product(q.query, r.ref), 9)), 6) AS median_true FROM queries q JOIN refs r ON r.ref_id = q.source_id WHERE positive GROUP BY 1")
def median_true_score(spark: SparkSession, d: str) -> DataFrame:
    q = vector_queries(spark, d).where("positive")
    t = retrieval.true_scores(q.select("query_id", "query"), references(spark, d), q.select("query_id", F.col("source_id").alias("ref_id")))
    scored = t.join(q.select("query_id", "attack"), "query_id")
    return calibrate.quantiles(scored, ["attack"], "score", {"median_true": 0.5}).select("attack", F.round("median_true", 6).alias("median_true"))


TARGETS = (0.05, 0.01)
CAL_SQL = TOP1_SQL + """,
src AS (SELECT source_id, row_number() OVER (ORDER BY source_id) % 2 = 1 AS calibration FROM (SELECT DISTINCT source_id FROM one WHERE NOT positive)),
neg AS (SELECT one.*, calibration FROM one JOIN src USING (source_id) WHERE NOT positive),
cal AS (SELECT top1, row_number() OVER (ORDER BY top1 DESC) - 1 AS pos, count(*) OVER () AS n FROM neg WHERE calibration),
tgt(target) AS (VALUES (0.05::DOUBLE), (0.01::DOUBLE)),
kk AS (SELECT target, max(n) AS n, floor(target * max(n))::BIGINT AS k FROM cal, tgt GROUP BY target),
thr AS (SELECT target, kk.n, kk.k, CASE WHEN kk.k >= 5 AND kk.k < kk.n THEN top1 + 1e-6 END AS threshold, kk.k >= 5 AND kk.k < kk.n AS resolved FROM kk LEFT JOIN cal ON cal.pos = kk.k)
"""


def _negatives(one: DataFrame) -> DataFrame:
    neg = one.where(~F.col("positive"))
    return neg.join(calibrate.keep_alternate(neg), "source_id")


def _thresholds(negatives: DataFrame) -> DataFrame:
    cal = negatives.where("calibration").select(F.lit("search").alias("method"), F.col("top1").alias("score"))
    return calibrate.query_thresholds(cal, list(TARGETS))


@query("CAL1 SPL1 FLT1", W + CAL_SQL + "SELECT target, n, k, round(threshold, 6) AS threshold, resolved FROM thr")
def query_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _thresholds(_negatives(_top1(spark, d))).select("target", "n", "k", F.round("threshold", 6).alias("threshold"), "resolved")


@query("AGG3", W + CAL_SQL + """
, t AS (SELECT threshold FROM thr WHERE target = 0.05),
p AS (SELECT attack, avg((hit AND top1 >= threshold)::INTEGER) AS tpr, count(*) AS n_pos FROM one, t WHERE positive GROUP BY attack),
f AS (SELECT attack, sum((top1 >= threshold)::INTEGER) / greatest(1, count(*)) AS fpr, count(*) AS n_neg FROM neg, t WHERE NOT calibration GROUP BY attack)
SELECT p.attack, round(tpr, 6) AS tpr, n_pos, round(coalesce(fpr, 0), 6) AS fpr, coalesce(n_neg, 0) AS n_neg FROM p LEFT JOIN f USING (attack)""")
def tpr_fpr_by_attack(spark: SparkSession, d: str) -> DataFrame:
    one = _top1(spark, d)
    neg = _negatives(one)
    t = _thresholds(neg).where(F.col("target") == TARGETS[0]).select("threshold")  # one row
    pos = one.where("positive").crossJoin(t)
    p = pos.groupBy("attack").agg(evaluate.share(F.col("hit") & (F.col("top1") >= F.col("threshold"))).alias("tpr"), F.count(F.lit(1)).alias("n_pos"))
    test = neg.where(~F.col("calibration")).crossJoin(t)
    f = test.groupBy("attack").agg(evaluate.over_max1(F.sum((F.col("top1") >= F.col("threshold")).cast("int")), F.count(F.lit(1))).alias("fpr"), F.count(F.lit(1)).alias("n_neg"))
    return p.join(f, "attack", "left").select("attack", F.round("tpr", 6).alias("tpr"), "n_pos", F.round(F.coalesce("fpr", F.lit(0.0)), 6).alias("fpr"), F.coalesce("n_neg", F.lit(0)).alias("n_neg"))


@query("AGG2 AGG9", W + """,
r AS (SELECT *, positive AND ref_id = source_id AS correct, CASE WHEN positive THEN 0 ELSE 1 END AS negative FROM topk),
o AS (SELECT correct, row_number() OVER w AS rn, sum(correct::INTEGER) OVER w AS hits FROM r WINDOW w AS (ORDER BY score DESC, negative, query_id, rank ROWS UNBOUNDED PRECEDING))
SELECT round(sum(CASE WHEN correct THEN hits / rn ELSE 0 END) / greatest(1, (SELECT count(*) FROM queries WHERE positive)), 6) AS micro_ap, count(*) AS n_results FROM o""")
def micro_ap(spark: SparkSession, d: str) -> DataFrame:
    s = searched(spark, d)
    r = s.select("score", (F.col("positive") & (F.col("ref_id") == F.col("source_id"))).alias("correct"), F.when(F.col("positive"), 0).otherwise(1).alias("negative"), F.col("query_id").alias("ord"), "rank")
    n_pos = vector_queries(spark, d).where("positive").count()
    return evaluate.micro_ap(r, n_pos).select(F.round("micro_ap", 6).alias("micro_ap"), "n_results")


@query("AGG7 RPT17", W + TOP1_SQL + """,
x AS (SELECT positive, min(top1) AS lo, max(top1) AS hi FROM one GROUP BY positive)
SELECT one.positive, least(floor((top1 - lo) / (hi - lo) * 60) + 1, 60)::INTEGER AS bin, count(*) AS n FROM one JOIN x ON x.positive = one.positive GROUP BY ALL""")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.histogram(_top1(spark, d), ["positive"], "top1").select("positive", "bin", "n")


@query("AGG8 ATK12", W + CAL_SQL + """
, src2 AS (SELECT item_id, max(source) AS product FROM items GROUP BY item_id)
SELECT attack, sum((a.product = b.product AND one.ref_id <> one.source_id AND top1 >= threshold)::INTEGER)::BIGINT AS bound, count(*) AS n
FROM one JOIN thr ON target = 0.05 LEFT JOIN src2 a ON a.item_id = one.source_id LEFT JOIN src2 b ON b.item_id = one.ref_id GROUP BY attack""")
def hard_negative_rate(spark: SparkSession, d: str) -> DataFrame:
    """Queries bound to another item of their own source above the threshold."""
    top = _top1(spark, d)
    t = _thresholds(_negatives(top)).where(F.col("target") == TARGETS[0]).select("threshold")  # one row
    product = table(spark, d, "items").groupBy("item_id").agg(F.max("source").alias("product"))
    own, theirs = product.select(F.col("item_id").alias("source_id"), F.col("product").alias("p1")), product.select(F.col("item_id").alias("ref_id"), F.col("product").alias("p2"))
    one = top.crossJoin(t).join(own, "source_id", "left").join(theirs, "ref_id", "left")
    bound = (F.col("p1") == F.col("p2")) & (F.col("ref_id") != F.col("source_id")) & (F.col("top1") >= F.col("threshold"))
    return one.groupBy("attack").agg(F.sum(bound.cast("bigint")).alias("bound"), F.count(F.lit(1)).alias("n"))


EVIDENCE_SQL = f"""
WITH {PDQ_SQL},
v0 AS (SELECT DISTINCT set_name, item_id, method, vec FROM descriptors_vec WHERE method IN ('SSCD-mixup', 'DINOv2-S') AND len(vec) = CASE method WHEN 'DINOv2-S' THEN 64 ELSE 96 END
  AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
v AS (SELECT set_name, item_id, method, list_transform(vec, lambda x: x::DOUBLE) AS v FROM v0),
pairs AS (
  SELECT DISTINCT q.set_name, q.item_id, 'PDQ' AS method, r.item_id AS anchor_id FROM c q, c r WHERE q.set_name IN ('dist', 'hard') AND r.set_name IN ('reg', 'neg') AND q.item_id <> r.item_id AND {APART} <= 16
  UNION SELECT DISTINCT q.set_name, q.item_id, q.method, r.item_id FROM v q JOIN v r ON q.method = r.method AND q.set_name IN ('dist', 'hard') AND r.set_name IN ('reg', 'neg') AND q.item_id <> r.item_id
    AND round(list_cosine_similarity(q.v, r.v), 9) >= CASE q.method WHEN 'DINOv2-S' THEN 0.95 ELSE 0.80 END)
"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """(set_name, item_id, method, anchor_id): items of dist and hard near an item of reg or neg, by each of three methods."""
    near, anchors = F.col("set_name").isin("dist", "hard"), F.col("set_name").isin("reg", "neg")
    methods = [("PDQ", "hamming", 256, 1 - 16 / 256, _codes(spark, d, "PDQ", 4).withColumnRenamed("words", "v"))]
    for method, dim, least in (("SSCD-mixup", 96, 0.80), ("DINOv2-S", 64, 0.95)):
        # Stored as single precision, of which the doubles are exact copies.
        methods.append((method, "cosine", dim, least, usable_vectors(spark, d, method, dim).withColumn("v", F.col("v").cast("array<float>"))))
    found = None
    for method, metric, dim, least, rows in methods:
        v = stage(rows.where(near | anchors).select("set_name", "item_id", "v"), "descriptors")
        pairs = retrieval.within(v.where(near).select(F.col("item_id").alias("query_id"), F.col("v").alias("query")), v.where(anchors).select(F.col("item_id").alias("ref_id"), F.col("v").alias("ref")), least, metric, dim).withColumn("method", F.lit(method))
        found = pairs if found is None else found.unionByName(pairs)
    sets = table(spark, d, "set_membership").where(F.col("set_name").isin("dist", "hard")).select("set_name", F.col("item_id").alias("query_id")).distinct()
    return found.join(sets, "query_id").select("set_name", F.col("query_id").alias("item_id"), "method", F.col("ref_id").alias("anchor_id"))


@query("JOI9 JOI10", EVIDENCE_SQL + "SELECT set_name, item_id, method, anchor_id FROM pairs")
def near_duplicate_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d)


@query("JOI9 JOI11 FLT2 RPT5", EVIDENCE_SQL + """,
a AS (SELECT DISTINCT item_id FROM pairs), t AS (SELECT DISTINCT item_id FROM (SELECT item_id, anchor_id FROM pairs GROUP BY ALL HAVING count(DISTINCT method) >= 2)),
m AS (SELECT DISTINCT set_name, item_id FROM set_membership WHERE set_name IN ('dist', 'hard'))
SELECT set_name, count(*) AS n_items, count(*) - count(a.item_id) AS kept_any, count(*) - count(t.item_id) AS kept_two, count(*) AS kept_none FROM m LEFT JOIN a ON a.item_id = m.item_id LEFT JOIN t ON t.item_id = m.item_id GROUP BY set_name""")
def dedup_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    e = stage(_evidence(spark, d), "evidence")
    m = table(spark, d, "set_membership").where(F.col("set_name").isin("dist", "hard")).select("set_name", "item_id").distinct()
    out = m.groupBy("set_name").agg(F.count(F.lit(1)).alias("n_items"))
    for mode in ("any", "two", "none"):
        kept = retrieval.without(m, retrieval.flags(e, mode), "item_id").groupBy("set_name").agg(F.count(F.lit(1)).alias(f"kept_{mode}"))
        out = out.join(kept, "set_name", "left").withColumn(f"kept_{mode}", F.coalesce(f"kept_{mode}", F.lit(0)))
    return out


@query("JOI12 JOI13", W + """,
alias0 AS (SELECT query_id, ref_id AS alias_id, source_id AS ref_id FROM topk WHERE positive AND attack = 'none' AND ref_id <> source_id AND score >= 0.9),
alias AS (SELECT alias_id, min(ref_id) AS asset FROM alias0 GROUP BY alias_id)
SELECT attack, sum((coalesce(asset, t.ref_id) = source_id)::INTEGER)::BIGINT AS hits, sum((t.ref_id = source_id)::INTEGER)::BIGINT AS hits_before, count(*) AS n
FROM topk t LEFT JOIN alias ON alias.alias_id = t.ref_id WHERE positive AND rank = 1 GROUP BY attack""")
def alias_rewrite(spark: SparkSession, d: str) -> DataFrame:
    s = searched(spark, d).where("positive")
    aliases = s.where((F.col("attack") == "none") & (F.col("ref_id") != F.col("source_id")) & (F.col("score") >= 0.9)).select(F.col("ref_id").alias("alias_id"), F.col("source_id").alias("ref_id"))
    top = s.where(F.col("rank") == 1).withColumn("before", F.col("ref_id"))
    r = retrieval.rewrite_aliases(top, aliases)
    return r.groupBy("attack").agg(F.sum((F.col("ref_id") == F.col("source_id")).cast("bigint")).alias("hits"), F.sum((F.col("before") == F.col("source_id")).cast("bigint")).alias("hits_before"), F.count(F.lit(1)).alias("n"))


@query("JOI14 AGG20", W + """,
mark AS (SELECT source_id, query FROM queries WHERE positive AND attack = 'quant'),
reg AS (SELECT r.ref_id, r.ref, coalesce(m.query, r.ref) AS now FROM refs r LEFT JOIN mark m ON m.source_id = r.ref_id),
s AS (SELECT ref_id, round(list_dot_product(ref, now), 9) AS self FROM reg)
SELECT round(median(self), 6) AS median_self, round(avg((self < 0.99)::INTEGER), 6) AS below, count(*) AS n FROM s""")
def registry_substitution(spark: SparkSession, d: str) -> DataFrame:
    refs = references(spark, d)
    marked = vector_queries(spark, d).where(F.col("positive") & (F.col("attack") == "quant")).select(F.col("source_id").alias("ref_id"), F.col("query").alias("ref"))
    now = retrieval.substitute(refs, marked, "ref_id", "ref").select("ref_id", F.col("ref").alias("now"))
    s = refs.join(now, "ref_id").select(F.round(retrieval.dot(F.col("ref"), F.col("now")), 9).alias("self"))
    return s.agg(F.round(F.median("self"), 6).alias("median_self"), F.round(F.avg((F.col("self") < 0.99).cast("int")), 6).alias("below"), F.count(F.lit(1)).alias("n"))


@query("SEC3 AGG16", W + TOP1_SQL + """
SELECT attack, round(avg(hit::INTEGER), 6) AS reid, round(1.0::DOUBLE / (SELECT count(*) FROM refs), 9) AS chance, count(*) AS n FROM one WHERE positive GROUP BY attack""")
def reidentification(spark: SparkSession, d: str) -> DataFrame:
    n = references(spark, d).agg(F.round(1.0 / F.count(F.lit(1)), 9).alias("chance"))  # one row
    return _top1(spark, d).where("positive").groupBy("attack").agg(F.round(evaluate.share(F.col("hit")), 6).alias("reid"), F.count(F.lit(1)).alias("n")).crossJoin(n).select("attack", "reid", "chance", "n")


@query("SEC2", W + """,
pairs AS (SELECT q.query_id, r.ref_id AS target, round(list_dot_product(q.query, r.ref), 9) AS s FROM queries q JOIN refs r ON r.ref_id = q.source_id WHERE positive AND attack <> 'none')
SELECT query_id, (1 + count(*) FILTER (WHERE score > s))::BIGINT AS target_rank FROM pairs JOIN scored USING (query_id) GROUP BY query_id""")
def collision_target_rank(spark: SparkSession, d: str) -> DataFrame:
    """Place of the wanted reference among all, for every transformed query."""
    q = vector_queries(spark, d).where(F.col("positive") & (F.col("attack") != "none"))
    refs = references(spark, d)
    own = retrieval.true_scores(q.select("query_id", "query"), refs, q.select("query_id", F.col("source_id").alias("ref_id"))).select("query_id", F.col("score").alias("s"))
    return retrieval.count_above(q.select("query_id", "query").join(own, "query_id"), refs, "s", "ip", VECTOR_DIM).select("query_id", (1 + F.col("n")).alias("target_rank"))
