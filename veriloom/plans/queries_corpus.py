"""Queries on corpora, designs, postings, localisation of edits, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriloom.functions import formats
from veriloom.operators import calibrate, design, evaluate, localize, postings, retrieval, transforms
from veriloom.plans.bindings import md5_word, sql_word, table, usable_vectors
from veriloom.plans.registry import query
from veriloom.plans.session import spread, stage


@query("FLT3 SET2", """
WITH c AS (SELECT DISTINCT config, item, clip FROM config_items WHERE config IS NOT NULL), n AS (SELECT count(DISTINCT modality) AS n FROM config_items)
SELECT item FROM config_items, n WHERE clip IS NULL AND item IS NOT NULL GROUP BY item HAVING count(DISTINCT modality) = any_value(n)""")
def corpus_bad_items(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "config_items")
    return design.failing_everywhere(c, "item", "modality", F.col("clip").isNull())


@query("FLT4", "SELECT clip, min(item) AS item FROM config_items WHERE clip IS NOT NULL GROUP BY clip HAVING count(DISTINCT item) = 1")
def unique_owner(spark: SparkSession, d: str) -> DataFrame:
    return design.unique_owner(table(spark, d, "config_items"), "clip", "item")


@query("FLT5", "SELECT source, item_id FROM (SELECT DISTINCT source, item_id FROM items WHERE source IS NOT NULL AND item_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws(':', 'pick', item_id)), item_id) = 1")
def one_per_source(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "items").where(F.col("item_id").isNotNull()).select("source", "item_id").distinct()
    return design.first_of(i, "source", design.hash_order(F.col("item_id"), "pick"), F.col("item_id"))


@query("FLT6 SRC10", r"""
SELECT licence, count(DISTINCT item_id) AS n, any_value(coalesce(regexp_matches(lower(licence), 'cc0|cc[ -]?by|public domain|mit|bsd|apache') AND NOT regexp_matches(lower(licence), '\bnc\b|\bnd\b|noncommercial|no ?deriv|research only'), false)) AS open FROM items GROUP BY licence""")
def open_licences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").groupBy("licence").agg(F.countDistinct("item_id").alias("n")).withColumn("open", design.open_licence(F.col("licence")))


@query("FLT7 SRT5", "SELECT author, edit_id FROM (SELECT DISTINCT author, edit_id FROM edits WHERE author IS NOT NULL AND area_actual >= 0.05) QUALIFY row_number() OVER (PARTITION BY author ORDER BY edit_id) = 1")
def first_per_author(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edits").where(F.col("area_actual") >= 0.05).select("author", "edit_id").distinct()
    return design.first_of(e, "author", F.col("edit_id"))


@query("FLT8", """
WITH p AS (SELECT item_id, row_number() OVER (ORDER BY md5(concat_ws(':', 'split', item_id)), item_id) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT item_id FROM items WHERE item_id IS NOT NULL))
SELECT item_id, CASE WHEN pos < round(0.25 * n) THEN 'reg' WHEN pos < round((0.25::DOUBLE + 0.25) * n) THEN 'neg' ELSE 'dist' END AS split FROM p""")
def rank_split(spark: SparkSession, d: str) -> DataFrame:
    return design.rank_split(table(spark, d, "items"), "item_id", [("reg", 0.25), ("neg", 0.25), ("dist", 0.5)], "split")


@query("FLT9", "SELECT abs(('0x' || substr(md5(concat_ws(':', 'shard', item_id)), 1, 15))::BIGINT % 8) AS shard, count(DISTINCT item_id) AS n FROM items WHERE item_id IS NOT NULL GROUP BY 1")
def shards(spark: SparkSession, d: str) -> DataFrame:
    """Items in each of eight shards by hash."""
    i = table(spark, d, "items").where(F.col("item_id").isNotNull())
    return i.groupBy(F.pmod(md5_word(F.lit("shard"), F.col("item_id")), F.lit(8)).alias("shard")).agg(F.countDistinct("item_id").alias("n"))


@query("PRJ1 ATK1", """
WITH a(attack, ord) AS (VALUES """ + ", ".join(f"('{n}', {i})" for i, n in enumerate(transforms.IMAGE_LADDER)) + """), s AS (SELECT DISTINCT item_id FROM set_membership WHERE set_name = 'pos')
SELECT item_id || '|' || attack AS query_id, item_id, attack, ord FROM s, a""")
def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Every source under every entry of the image ladder."""
    a = spark.createDataFrame([(n, i) for i, n in enumerate(transforms.IMAGE_LADDER)], "attack string, ord int")
    s = table(spark, d, "set_membership").where(F.col("set_name") == "pos").select("item_id").distinct()
    return design.expand(s, a, "item_id").select("query_id", "item_id", "attack", "ord")


@query("PRJ2 PRJ3 PRJ4 PRJ5", r"""
SELECT DISTINCT edit_key, split_part(edit_key, '|', 1) AS source_id, split_part(edit_key, '|', 2) AS spec, CASE WHEN edit_key LIKE 'm%' THEN 'music' ELSE 'speech' END AS kind,
  coalesce(try_cast(split_part(split_part(edit_key, '|', 2), '_', 2) AS DOUBLE), try_cast(split_part(split_part(edit_key, '|', 2), '_', 4) AS DOUBLE)) AS strength,
  CASE WHEN edit_type IN ('splice', 'copymove') THEN 'paste' WHEN edit_type IS NULL THEN 'unknown' ELSE edit_type END AS network FROM edits WHERE edit_key IS NOT NULL""")
def key_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields read from a query key once, at ingest."""
    e = table(spark, d, "edits").where(F.col("edit_key").isNotNull())
    spec = F.split_part("edit_key", F.lit("|"), F.lit(2))
    part = lambda i: F.split_part(spec, F.lit("_"), F.lit(i)).try_cast("double")
    network = F.when(F.col("edit_type").isin("splice", "copymove"), "paste").when(F.col("edit_type").isNull(), "unknown").otherwise(F.col("edit_type"))
    return e.select("edit_key", F.split_part("edit_key", F.lit("|"), F.lit(1)).alias("source_id"), spec.alias("spec"), F.when(F.col("edit_key").startswith("m"), "music").otherwise("speech").alias("kind"), F.coalesce(part(2), part(4)).alias("strength"), network.alias("network")).distinct()


@query("PRJ6 RPT1 FPR9 PAY15", """
SELECT method, family, metric, dim, CASE WHEN metric = 'hamming' THEN dim WHEN metric IN ('ip', 'l2') THEN 32 * dim END AS bits, coalesce(tier, '?') AS tier, coalesce(CASE metric WHEN 'hamming' THEN 1 WHEN 'ip' THEN 2 WHEN 'l2' THEN 3 END, 99) AS class_order FROM methods""")
def method_inventory(spark: SparkSession, d: str) -> DataFrame:
    m, metric = table(spark, d, "methods"), F.col("metric")
    order = spark.createDataFrame([("hamming", 1), ("ip", 2), ("l2", 3)], "metric string, class_order int")
    bits = F.when(metric == "hamming", F.col("dim")).when(metric.isin("ip", "l2"), 32 * F.col("dim"))
    return m.join(F.broadcast(order), "metric", "left").select("method", "family", "metric", "dim", bits.alias("bits"), F.coalesce("tier", F.lit("?")).alias("tier"), F.coalesce("class_order", F.lit(99)).alias("class_order"))


GRID = {"edit_type": ["splice", "copymove", "inpaint", "faceswap", "text", "remove"], "area": ["0.01", "0.03", "0.1", "0.25"], "post": ["none", "jpeg75", "resize", "crop90"]}


@query("DSN1", """
WITH t AS (SELECT unnest(['splice', 'copymove', 'inpaint', 'faceswap', 'text', 'remove']) AS edit_type), a AS (SELECT unnest(['0.01', '0.03', '0.1', '0.25']) AS area), p AS (SELECT unnest(['none', 'jpeg75', 'resize', 'crop90']) AS post),
g AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', 'grid', concat_ws('|', edit_type, area, post)))) - 1 AS cell FROM t, a, p),
s AS (SELECT item_id, row_number() OVER (ORDER BY md5(concat_ws(':', 'grid', item_id)), item_id) - 1 AS pos FROM (SELECT DISTINCT item_id FROM set_membership WHERE set_name = 'pos' AND item_id IS NOT NULL)),
j AS (SELECT item_id, pos, unnest(range(12)) AS j FROM s)
SELECT item_id, j::INTEGER AS j, edit_type, area, post FROM j JOIN g ON cell = (pos * 12 + j) % 96""")
def balanced_design(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "set_membership").where(F.col("set_name") == "pos")
    return design.balanced_design(s, "item_id", GRID, 12, "grid")


@query("DSN2", "SELECT j, j % 97 AS source, (7 * j + 3) % 89 AS target FROM (SELECT unnest(range(500)) AS j)")
def collision_pairs(spark: SparkSession, d: str) -> DataFrame:
    return design.collision_pairs(97, 89, 500, spark)


@query("EDT5 AGG11 AGG15 RPT6", """
WITH e AS (SELECT DISTINCT edit_id, edit_type, post, area, area_actual, visible_frac FROM edits)
SELECT CASE WHEN grouping(edit_type) = 0 THEN 'edit_type' WHEN grouping(post) = 0 THEN 'post' WHEN grouping(area) = 0 THEN 'area' ELSE '_all' END AS stratum,
  CASE WHEN grouping(edit_type) = 0 THEN coalesce(edit_type, 'missing') WHEN grouping(post) = 0 THEN coalesce(post, 'missing') WHEN grouping(area) = 0 THEN coalesce(area::VARCHAR, 'missing') ELSE '_all' END AS level,
  round(avg(visible_frac), 6) AS visible, round(avg(area_actual), 6) AS area_mean, count(*) AS n FROM e GROUP BY GROUPING SETS ((edit_type), (post), (area), ())""")
def edit_strata(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edits").select("edit_id", "edit_type", "post", "area", "area_actual", "visible_frac").distinct()
    return evaluate.by_stratum(e, ["edit_type", "post", "area"], F.round(F.avg("visible_frac"), 6).alias("visible"), F.round(F.avg("area_actual"), 6).alias("area_mean"), F.count(F.lit(1)).alias("n"))


@query("AGG14", """
WITH e AS (SELECT DISTINCT edit_id, edit_type, abs(100 * (area_actual - area)) AS err FROM edits)
SELECT coalesce(edit_type, 'missing') AS edit_type, round(median(err), 6) AS median_error, round(avg(coalesce((err <= 0.5)::INTEGER, 0)), 6) AS within_half, round(avg(coalesce((err <= 1)::INTEGER, 0)), 6) AS within_1, round(avg(coalesce((err <= 2)::INTEGER, 0)), 6) AS within_2, count(*) AS n FROM e GROUP BY 1""")
def area_error_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edits").select("edit_id", F.coalesce("edit_type", F.lit("missing")).alias("edit_type"), (100 * (F.col("area_actual") - F.col("area"))).alias("err")).distinct()
    s = localize.error_summary(e, ["edit_type"], "err")
    return s.select("edit_type", *[F.round(c, 6).alias(c) for c in ("median_error", "within_half", "within_1", "within_2")], "n")


@query("JOI19 LOC16", """
WITH e AS (SELECT edit_id, max(nullif(regexp_extract(lower(src), '(p[a-z0-9]{8})', 1), '')) AS src, max(visible_frac) AS f FROM edits GROUP BY edit_id),
h AS (SELECT DISTINCT nullif(regexp_extract(lower(item), '(p[a-z0-9]{8})', 1), '') AS src FROM config_items)
SELECT round(avg(CASE WHEN h.src IS NOT NULL THEN coalesce(f, 0) ELSE 0 END), 6) AS end_to_end, round(avg(f) FILTER (WHERE h.src IS NOT NULL), 6) AS given_hit, count(*) AS n FROM e LEFT JOIN h ON h.src = e.src""")
def end_to_end_score(spark: SparkSession, d: str) -> DataFrame:
    """A localisation score that is 0 where retrieval, a source among the evaluated items, missed."""
    found = lambda c: F.nullif(F.regexp_extract(F.lower(c), "(p[a-z0-9]{8})", 1), F.lit(""))
    e = table(spark, d, "edits").groupBy("edit_id").agg(F.max(found(F.col("src"))).alias("src"), F.max("visible_frac").alias("f"))
    h = table(spark, d, "config_items").select(found(F.col("item")).alias("src")).where(F.col("src").isNotNull()).distinct().withColumn("hit", F.lit(True))
    j = e.join(h, "src", "left")
    return j.agg(F.round(F.avg(F.when(F.col("hit"), F.coalesce("f", F.lit(0.0))).otherwise(0.0)), 6).alias("end_to_end"), F.round(F.avg(F.when(F.col("hit"), F.col("f"))), 6).alias("given_hit"), F.count(F.lit(1)).alias("n"))


@query("LOC12", """
WITH f AS (SELECT user_id, ts, event_id, event_type IN ('view', 'click') AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events WHERE user_id IS NOT NULL),
g AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS island FROM f WHERE f),
r AS (SELECT user_id, min(i) AS s, count(*) AS n FROM g GROUP BY user_id, island)
SELECT user_id, s AS start, s + n AS "end" FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, s) = 1""")
def longest_run(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where(F.col("user_id").isNotNull()).select("user_id", "ts", "event_id", F.col("event_type").isin("view", "click").alias("f"))
    return localize.longest_run(e, "user_id", ["ts", "event_id"], "f")


@query("LOC13", """
WITH f AS (SELECT user_id, event_type IN ('view', 'click') AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events WHERE user_id IS NOT NULL),
g AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS island FROM f WHERE f),
r AS (SELECT user_id, min(i) AS s, count(*) AS n FROM g GROUP BY user_id, island),
b AS (SELECT user_id, s::DOUBLE AS a, (s + n)::DOUBLE AS z FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, s) = 1)
SELECT user_id, round(greatest(0, least(z, 3.75) - greatest(a, 1.25)) / ((z - a) + 2.5 - greatest(0, least(z, 3.75) - greatest(a, 1.25))), 6) AS iou FROM b""")
def interval_iou(spark: SparkSession, d: str) -> DataFrame:
    r = longest_run(spark, d).select("user_id", F.col("start").cast("double").alias("a"), F.col("end").cast("double").alias("z"))
    return localize.interval_iou(r, "a", "z", 1.25, 3.75).select("user_id", F.round("iou", 6).alias("iou"))


@query("SRC5 UDF3", """
WITH s AS (SELECT user_id, epoch(ts) AS t FROM events WHERE user_id IS NOT NULL), z AS (SELECT user_id, min(t) AS t0 FROM s GROUP BY user_id),
k AS (SELECT user_id, t - t0 AS s, floor((t - t0) * (1 / 3600.0::DOUBLE) - 0.5)::BIGINT AS k FROM s JOIN z USING (user_id))
SELECT user_id, k, round(min(s), 3) AS t FROM k WHERE k >= 0 GROUP BY ALL""")
def frame_samples(spark: SparkSession, d: str) -> DataFrame:
    """One event an hour of each user, as frames are sampled from a clip."""
    e = table(spark, d, "events").where(F.col("user_id").isNotNull()).select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"))
    return design.frame_samples(e.select("user_id", (F.col("us") / 1e6).alias("t")), "user_id", "t", 1 / 3600.0).select("user_id", "k", F.round("t", 3).alias("t"))


@query("LOC10", """
WITH p AS (SELECT a.l_orderkey AS k, a.l_linenumber AS q, b.l_linenumber AS r, 1 - abs(a.l_quantity - b.l_quantity) / 50.0::DOUBLE AS sim FROM lineitem a JOIN lineitem b ON a.l_orderkey + 1 = b.l_orderkey),
n AS (SELECT k, count(DISTINCT q) AS nq FROM p GROUP BY k), o AS (SELECT k, r - q AS off, round(avg(sim), 9) AS m, count(*) AS c FROM p GROUP BY ALL)
SELECT o.k, off AS "offset", round(m, 6) AS mean_sim, c AS overlap FROM o JOIN n USING (k) WHERE c >= greatest(2, floor(nq / 3)) QUALIFY row_number() OVER (PARTITION BY o.k ORDER BY m DESC, off) = 1""")
def diagonal_offset(spark: SparkSession, d: str) -> DataFrame:
    """Best shift of each order's lines against those of the next order, as clips are aligned by their frames."""
    li = table(spark, d, "lineitem")
    a = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("q"), F.col("l_quantity").alias("x"))
    b = li.select((F.col("l_orderkey") - 1).alias("k"), F.col("l_linenumber").alias("r"), F.col("l_quantity").alias("y"))
    p = a.join(b, "k").select("k", "q", "r", (1 - F.abs(F.col("x") - F.col("y")) / 50.0).alias("sim"))
    return localize.diagonal_offset(p, "k", "q", "r", "sim").select("k", "offset", F.round("mean_sim", 6).alias("mean_sim"), "overlap")


@query("LOC6", "SELECT l_returnflag, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(concat_ws(':', 'pixels', l_orderkey || '-' || l_linenumber)), l_orderkey || '-' || l_linenumber) <= 4000")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """At most 4000 lines of each return flag, which is the feature of this operator."""
    li = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key"))
    return localize.hash_sample(li, ["l_returnflag"], "key", 4000, "pixels").drop("key")


SHINGLE_SQL = r"""
qw AS (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM eval_items WHERE text IS NOT NULL),
rw AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
qp AS (SELECT id, w, unnest(range(len(w) - 4)) AS pos FROM qw WHERE len(w) >= 5), rp AS (SELECT id, w, unnest(range(len(w) - 4)) AS pos FROM rw WHERE len(w) >= 5),
qs AS (SELECT id AS query_id, pos, ('0x' || substr(md5(array_to_string(w[pos + 1:pos + 5], ' ')), 1, 15))::BIGINT AS hash FROM qp),
rs AS (SELECT id AS ref_id, pos, ('0x' || substr(md5(array_to_string(w[pos + 1:pos + 5], ' ')), 1, 15))::BIGINT AS hash FROM rp),
votes AS (SELECT query_id, ref_id, r.pos - q.pos AS off, count(*) AS votes FROM (SELECT DISTINCT * FROM qs) q JOIN (SELECT DISTINCT * FROM rs) r USING (hash) WHERE query_id <> ref_id GROUP BY ALL)
"""


def _postings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = postings.shingles(table(spark, d, "eval_items"), "item_id", "text").withColumnRenamed("item_id", "query_id")
    return q, postings.shingles(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text").withColumnRenamed("doc_id", "ref_id")


def _votes(spark: SparkSession, d: str) -> DataFrame:
    return postings.offset_votes(*_postings(spark, d))


CANDIDATES_SQL = SHINGLE_SQL + """,
cells AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, ref_id, off) AS c FROM votes),
one AS (SELECT *, row_number() OVER (PARTITION BY query_id, ref_id ORDER BY votes DESC, off) AS r FROM cells WHERE c <= 200),
cand AS (SELECT query_id, ref_id, off, votes, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, ref_id, off) AS rank FROM one WHERE r = 1)
"""


@query("JOI3 JOI4 FPR10 FPR12 SRT2", "WITH " + CANDIDATES_SQL + 'SELECT query_id, ref_id, off AS "offset", votes, rank::INTEGER AS rank FROM cand WHERE rank <= 20')
def offset_vote(spark: SparkSession, d: str) -> DataFrame:
    return postings.best_candidates(_votes(spark, d)).select("query_id", "ref_id", "offset", "votes", "rank")


@query("SIM8", "WITH " + SHINGLE_SQL + """,
best AS (SELECT query_id, ref_id, off AS o FROM votes QUALIFY row_number() OVER (PARTITION BY query_id, ref_id ORDER BY votes DESC, off) = 1)
SELECT query_id, ref_id, sum(votes)::BIGINT AS count FROM votes JOIN best USING (query_id, ref_id) WHERE abs(off - o) <= 1 GROUP BY ALL""")
def landmark_count(spark: SparkSession, d: str) -> DataFrame:
    return postings.aligned_counts(_votes(spark, d))


@query("SIM7 LOC11", "WITH " + CANDIDATES_SQL + """,
tried AS (SELECT DISTINCT query_id, ref_id, off + unnest(range(-2, 3)) AS o FROM cand WHERE rank <= 20),
nq AS (SELECT query_id, count(*) AS nq FROM qs GROUP BY 1),
m AS (SELECT t.query_id, t.ref_id, o, sum(bit_count(xor(q.hash & 4294967295, r.hash & 4294967295)))::BIGINT AS wrong, count(*) AS n FROM tried t JOIN qs q ON q.query_id = t.query_id JOIN rs r ON r.ref_id = t.ref_id AND r.pos = q.pos + o GROUP BY ALL)
SELECT query_id, ref_id, round(greatest(0.0, max(CASE WHEN n >= least(20, nq) THEN 1.0 - wrong / (32.0::DOUBLE * n) ELSE 0.0 END)), 9) AS score FROM m JOIN nq USING (query_id) GROUP BY ALL""")
def sequence_ber(spark: SparkSession, d: str) -> DataFrame:
    q, r = (stage(p, "postings") for p in _postings(spark, d))  # read for the votes and for the words
    word = F.col("hash").bitwiseAND(F.lit(4294967295))
    cand = postings.best_candidates(postings.offset_votes(q, r))
    return postings.sequence_similarity(q.select("query_id", "pos", word.alias("word")), r.select("ref_id", "pos", word.alias("word")), cand).withColumn("score", F.round("score", 9))


@query("SIM10", "WITH " + SHINGLE_SQL + """,
nq AS (SELECT query_id, count(DISTINCT pos) AS n FROM qs GROUP BY 1), nr AS (SELECT ref_id, count(DISTINCT pos) AS n FROM rs GROUP BY 1),
m AS (SELECT query_id, ref_id, count(DISTINCT q.pos) AS mq, count(DISTINCT r.pos) AS mr FROM qs q JOIN rs r USING (hash) GROUP BY ALL)
SELECT query_id, ref_id, round(mq / nq.n + 0.001::DOUBLE * mr / nr.n, 6) AS score FROM m JOIN nq USING (query_id) JOIN nr USING (ref_id)""")
def frame_share(spark: SparkSession, d: str) -> DataFrame:
    q, r = _postings(spark, d)
    return postings.frame_share(q, r).withColumn("score", F.round("score", 6))


@query("JOI5 SIM9", "WITH " + CANDIDATES_SQL + """,
pairs AS (SELECT query_id, ref_id, r.pos - q.pos AS o, 1 - bit_count(xor(q.hash & 4294967295, r.hash & 4294967295))::DOUBLE / 32 AS sim FROM cand JOIN qs q USING (query_id) JOIN rs r USING (ref_id) WHERE rank <= 20 AND abs(r.pos - q.pos - off) <= 1)
SELECT query_id, ref_id, round(max(m), 9) AS score FROM (SELECT query_id, ref_id, o, avg(sim) AS m FROM pairs GROUP BY ALL) GROUP BY ALL""")
def segment_vote(spark: SparkSession, d: str) -> DataFrame:
    q, r = (stage(p, "postings") for p in _postings(spark, d))
    cand = postings.best_candidates(postings.offset_votes(q, r))
    word = lambda c: F.col(c).bitwiseAND(F.lit(4294967295))
    # Segments are paired on the positions that an offset near the voted one gives.
    near = cand.withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).select("query_id", "ref_id", (F.col("offset") + F.col("step")).alias("o"))
    p = near.join(q.select("query_id", F.col("pos").alias("qp"), word("hash").alias("qw")), "query_id").withColumn("rp", F.col("qp") + F.col("o"))
    p = p.join(r.select("ref_id", F.col("pos").alias("rp"), word("hash").alias("rw")), ["ref_id", "rp"]).withColumn("sim", 1 - F.bit_count(F.col("qw").bitwiseXOR(F.col("rw"))) / 32.0)
    return postings.segment_alignment(p.select("query_id", "ref_id", "qp", "rp", "sim"), cand).withColumn("score", F.round("score", 9))


@query("FPR11 FPR17", r"""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS t FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 15))::BIGINT AS h FROM w), b AS (SELECT unnest(range(32)) AS b),
s AS (SELECT doc_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM h, b GROUP BY ALL)
SELECT doc_id, sum(CASE WHEN s > 0 THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS code FROM s GROUP BY doc_id""")
def simhash_codes(spark: SparkSession, d: str) -> DataFrame:
    w = spread(table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "text")).select("doc_id", F.explode(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")).alias("t"))
    return postings.simhash(w, "doc_id", "t")


@query("FPR18 SIM11", r"""
WITH v0 AS (SELECT DISTINCT set_name, item_id, vec FROM descriptors_vec WHERE method = 'DINOv2-S' AND len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
s AS (SELECT item_id, max(source) AS source FROM items GROUP BY 1), x AS (SELECT source, unnest(vec)::DOUBLE AS x, unnest(range(64)) AS i FROM v0 JOIN s USING (item_id) WHERE source IS NOT NULL),
m AS (SELECT source, i, avg(x) AS m FROM x GROUP BY ALL), n AS (SELECT source, greatest(sqrt(sum(m * m)), 1e-12) AS n FROM m GROUP BY 1)
SELECT source, round(max(m / n) FILTER (WHERE i = 0), 6) AS x0, round(max(m / n) FILTER (WHERE i = 63), 6) AS x63, round(sum(m / n), 6) AS total FROM m JOIN n USING (source) GROUP BY source""")
def segment_pool_cosine(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "items").groupBy("item_id").agg(F.max("source").alias("source"))
    v = usable_vectors(spark, d, "DINOv2-S", 64).join(src, "item_id").select("source", "v")
    m = postings.mean_vectors(v, "source", "v")
    return m.select("source", F.round(F.col("vec")[0], 6).alias("x0"), F.round(F.col("vec")[63], 6).alias("x63"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


KEY_BITS = 32


@query("FPR7 SEC4 SCA6", f"""
WITH s AS (SELECT i, b, CASE WHEN {sql_word("'key'", 'i', 'b')} % 2 = 1 THEN 1 ELSE -1 END AS sg, CASE WHEN {sql_word("'wrong'", 'i', 'b')} % 2 = 1 THEN 1 ELSE -1 END AS sw FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range({KEY_BITS})) AS b)),
x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings),
p AS (SELECT vec_id, b, round(sum(x * sg), 9) AS p, round(sum(x * sw), 9) AS w FROM x JOIN s USING (i) GROUP BY ALL)
SELECT vec_id, sum(CASE WHEN p > 0 THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS code, sum(CASE WHEN w > 0 THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS wrong_code FROM p GROUP BY vec_id""")
def keyed_codes(spark: SparkSession, d: str) -> DataFrame:
    """Signs of keyed random projections of the embeddings, and those of another key."""
    from veriloom.operators import features

    e = table(spark, d, "embeddings")
    right = features.keyed_code(F.col("embedding"), "key", 64, KEY_BITS)
    wrong = features.keyed_code(F.col("embedding"), "wrong", 64, KEY_BITS)
    return e.select("vec_id", right.alias("code"), wrong.alias("wrong_code"))


@query("JOI1 SIM2 SRT1", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, round(list_dot_product(q.v, r.v), 9) AS score FROM e q JOIN e r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, ref_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id)::INTEGER AS rank FROM s QUALIFY rank <= 10""")
def embedding_search(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set, ids divisible by 50, against all embeddings."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("query"))
    found = retrieval.top_k(q, e.select(F.col("vec_id").alias("ref_id"), F.col("v").alias("ref")), 11, "ip", 64).where(F.col("query_id") != F.col("ref_id"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "ref_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= 10).select("query_id", "ref_id", F.round("score", 6).alias("score"), "rank")


@query("SRC12 SNK5", r"""
WITH l AS (SELECT item_id, max(nullif(regexp_extract(lower(sha256), '([0-9a-f]{64})', 1), '')) AS locked FROM items GROUP BY 1),
f AS (SELECT DISTINCT item_id, sha256 FROM items)
SELECT CASE WHEN f.sha256 IS NULL THEN 'missing' WHEN f.sha256 = locked THEN 'equal' WHEN nullif(regexp_extract(lower(f.sha256), '([0-9a-f]{64})', 1), '') = locked THEN 'spelling' ELSE 'differs' END AS status, count(*) AS n FROM f LEFT JOIN l USING (item_id) GROUP BY 1""")
def verify_lock(spark: SparkSession, d: str) -> DataFrame:
    from veriloom.sources import manifest

    i = table(spark, d, "items").select("item_id", "sha256")
    digest = F.nullif(F.regexp_extract(F.lower("sha256"), "([0-9a-f]{64})", 1), F.lit(""))
    lock = i.groupBy("item_id").agg(F.max(digest).alias("locked"))
    return manifest.verify(i.distinct(), lock, "item_id", "sha256").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SET1 SET2 SET3 SET4 SRC13", """
WITH m AS (SELECT DISTINCT set_name, item_id FROM set_membership)
SELECT 'reg and pos' AS what, count(*) AS n FROM (SELECT item_id FROM m WHERE set_name = 'reg' INTERSECT SELECT item_id FROM m WHERE set_name = 'pos')
UNION ALL SELECT 'reg not pos', count(*) FROM (SELECT item_id FROM m WHERE set_name = 'reg' EXCEPT SELECT item_id FROM m WHERE set_name = 'pos')
UNION ALL SELECT 'any', count(*) FROM (SELECT item_id FROM m)
UNION ALL SELECT 'unused', count(*) FROM (SELECT item_id FROM items EXCEPT SELECT item_id FROM m)
UNION ALL SELECT 'with extra', count(*) FROM (SELECT set_name, item_id FROM m UNION SELECT 'extra', item_id FROM m WHERE set_name = 'hard')""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    from veriloom.sources import manifest

    m = table(spark, d, "set_membership").select("set_name", "item_id").distinct()
    of = lambda s: m.where(F.col("set_name") == s).select("item_id")
    extra = manifest.register_set(m, of("hard"), "extra")
    parts = (("reg and pos", of("reg").intersect(of("pos"))), ("reg not pos", of("reg").subtract(of("pos"))), ("any", m.select("item_id")), ("unused", table(spark, d, "items").select("item_id").subtract(m.select("item_id"))), ("with extra", extra))
    out = None
    for name, df in parts:
        c = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        out = c if out is None else out.unionByName(c)
    return out


@query("SCA1 SCA2 SNK4 RPT11 D20", """
SELECT source, printf('%.3f', round(share, 3)) AS fixed, printf('%.1f', round(100 * share, 1)) || '%' AS pct, format('{:,}', n) AS thousands FROM (SELECT coalesce(source, 'missing') AS source, count(*) AS n, round(avg((licence IS NOT NULL)::INTEGER), 9) AS share FROM items GROUP BY 1)""")
def report_values(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "items").groupBy(F.coalesce("source", F.lit("missing")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.round(evaluate.share(F.col("licence").isNotNull()), 9).alias("share"))
    return a.select("source", formats.fixed(F.col("share"), 3).alias("fixed"), formats.percent(F.col("share"), 1).alias("pct"), formats.thousands(F.col("n")).alias("thousands"))


@query("RPT17", """
WITH s AS (SELECT DISTINCT item_id, set_name, modality FROM set_membership)
SELECT coalesce(modality, 'missing') AS modality, count(*) FILTER (WHERE set_name = 'reg') AS reg, count(*) FILTER (WHERE set_name = 'dist') AS dist, count(*) FILTER (WHERE set_name = 'neg') AS neg, count(*) FILTER (WHERE set_name = 'hard') AS hard FROM s GROUP BY 1""")
def set_pivot(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "set_membership").select("item_id", "set_name", F.coalesce("modality", F.lit("missing")).alias("modality")).distinct()
    return s.groupBy("modality").pivot("set_name", ["reg", "dist", "neg", "hard"]).agg(F.count(F.lit(1))).na.fill(0)


@query("LAT3", "SELECT l_shipmode_key AS k, round(median(l_extendedprice), 6) AS median_ms, count(*) AS n FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_key, l_extendedprice FROM lineitem WHERE l_linenumber > 1) GROUP BY 1")
def latency_median(spark: SparkSession, d: str) -> DataFrame:
    """Median of a measurement without the first one of each order."""
    li = table(spark, d, "lineitem").where(F.col("l_linenumber") > 1)
    rows = li.select(F.concat("l_returnflag", "l_linestatus").alias("k"), "l_extendedprice")
    return calibrate.quantiles(rows, ["k"], "l_extendedprice", {"median_ms": 0.5}).select("k", F.round("median_ms", 6).alias("median_ms"), "n")


@query("SCA3 SCA4", """
SELECT l_orderkey, bit_xor(l_partkey) AS folded, sum(bit_count(l_suppkey))::BIGINT AS ones, list_aggregate(list_sort(list(l_linenumber)), 'first')::INTEGER AS first_line FROM lineitem GROUP BY l_orderkey""")
def bit_and_array_scalars(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bit_xor("l_partkey").alias("folded"), F.sum(F.bit_count("l_suppkey").cast("bigint")).alias("ones"), F.element_at(F.array_sort(F.collect_list("l_linenumber")), 1).alias("first_line"))


@query("SCA3", """
WITH x AS (SELECT o_custkey % 25 AS g, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_orderkey) - 1 AS i FROM orders),
s AS (SELECT a.g, b.i - a.i AS shift, round(sum(a.o_totalprice / 1e5 * b.o_totalprice / 1e5), 6) AS dot FROM x a JOIN x b ON a.g = b.g AND b.i - a.i BETWEEN 1 AND 16 GROUP BY ALL)
SELECT g, shift, dot FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY dot DESC, shift) = 1""")
def best_shift(spark: SparkSession, d: str) -> DataFrame:
    """Shift of 1 to 16 at which the order totals of a group correlate best with themselves."""
    x = table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("g"), "o_orderkey", (F.col("o_totalprice") / 1e5).alias("p"))
    x = x.withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("o_orderkey")) - 1)
    a, b = x.select("g", F.explode(F.sequence(F.lit(1), F.lit(16))).alias("shift"), "i", F.col("p").alias("pa")).withColumn("j", F.col("i") + F.col("shift")), x.select("g", F.col("i").alias("j"), F.col("p").alias("pb"))
    s = a.join(b, ["g", "j"]).groupBy("g", "shift").agg(F.round(F.sum(F.col("pa") * F.col("pb")), 6).alias("dot"))
    best = Window.partitionBy("g").orderBy(F.col("dot").desc(), "shift")
    return s.withColumn("rn", F.row_number().over(best)).where(F.col("rn") == 1).select("g", F.col("shift").cast("bigint").alias("shift"), "dot")


@query("STR2", """SELECT date_trunc('hour', ts)::TIMESTAMP AS start, count(*) AS n, sum(coalesce((event_type = 'error')::INTEGER, 0))::BIGINT AS errors FROM events WHERE ts IS NOT NULL GROUP BY 1""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Share of errors by hour of the event stream, computed by a stream with a watermark and read back."""
    from veriloom.streaming import online

    w = online.run_windows(spark, f"{d}/events.parquet")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "errors")


@query("LOC8 EDT3", r"""
WITH p AS (SELECT edit_id, list_filter(regexp_split_to_array(lower(edit_key), '[|_]'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(lower(src), '[|_]'), lambda x: x <> '') AS b FROM (SELECT DISTINCT edit_id, edit_key, src FROM edits WHERE edit_id IS NOT NULL)),
z AS (SELECT edit_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM p), x AS (SELECT edit_id, a, b, unnest(range(greatest(len(a), len(b)))) AS pos FROM z),
t AS (SELECT edit_id, pos, coalesce((a[pos + 1] <> b[pos + 1])::INTEGER, 1) AS differs FROM x)
SELECT edit_id, pos::INTEGER AS pos, differs, round(avg(differs) OVER (PARTITION BY edit_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS score FROM t""")
def token_difference(spark: SparkSession, d: str) -> DataFrame:
    """Parts of an edit's key that differ from those of its source's spelling."""
    spaced = lambda c: F.regexp_replace(F.regexp_replace(c, r"\s", "~"), r"[|_]", " ")
    e = table(spark, d, "edits").where(F.col("edit_id").isNotNull()).select("edit_id", "edit_key", "src").distinct()
    t = localize.token_difference(e.select("edit_id", spaced("edit_key").alias("a"), spaced("src").alias("b")), "edit_id", "a", "b")
    return t.withColumn("score", F.round("score", 6))


@query("SRT4", """
SELECT source, row_number() OVER (ORDER BY CASE WHEN source LIKE 'open%' THEN 0 WHEN source LIKE 'coll1%' THEN 1 ELSE 2 END, source)::INTEGER AS place FROM (SELECT DISTINCT source FROM items WHERE source IS NOT NULL)""")
def preferred_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources in order of a preferred prefix, then by name."""
    from veriloom.plans.prefix import running_total

    s = table(spark, d, "items").where(F.col("source").isNotNull()).select("source").distinct().withColumn("one", F.lit(1))
    rank = F.when(F.col("source").startswith("open"), 0).when(F.col("source").startswith("coll1"), 1).otherwise(2)
    s = s.withColumn("pref", rank)
    return running_total(s, [], [F.col("pref"), F.col("source")], "one", "place").select("source", F.col("place").cast("int").alias("place"))


@query("FPR2 FPR4 FPR20 LAT1 LAT2 LAT4 UDF1")
def extraction_latency(spark: SparkSession, d: str) -> DataFrame:
    """Descriptors of the embeddings taken as grey pictures by a registered extractor, with their CPU time."""
    from veriloom.operators import features

    grey = F.transform("embedding", lambda x: F.least(F.greatest(F.round((x + 0.5) * 255), F.lit(0.0)), F.lit(255.0)).cast("int"))
    hexed = F.array_join(F.transform(grey, lambda x: F.lpad(F.hex(x), 2, "0")), "")
    items = table(spark, d, "embeddings").select("vec_id", F.unhex(hexed).alias("content"))
    t = features.timed_extract(items, "blockhash", "vec_id", "content")
    return t.select("vec_id", F.size("vec").alias("bits"), "cpu_ms")


@query("ATK5 ATK6 ATK9 ATK11", """
SELECT modality, family, n FROM (VALUES ('image', 'none', 1), ('image', 'compression', 4), ('image', 'scale', 3), ('image', 'crop', 5), ('image', 'geometric', 7), ('image', 'photometric', 9), ('image', 'overlay', 5), ('image', 'chain', 2),
  ('audio', 'none', 1), ('audio', 'codec', 4), ('audio', 'noise', 4), ('audio', 'filter', 4), ('audio', 'time-pitch', 4), ('audio', 'excerpt', 2), ('audio', 'chain', 2),
  ('video', 'none', 1), ('video', 'codec', 3), ('video', 'scale', 2), ('video', 'crop', 2), ('video', 'geometric', 4), ('video', 'photometric', 5), ('video', 'overlay', 3), ('video', 'temporal', 4), ('video', 'chain', 1)) AS t(modality, family, n)""")
def attack_ladders(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the transformation ladders by family."""
    from veriloom.operators import transforms

    rows = [("image", n, f) for n, (f, _) in transforms.IMAGE_LADDER.items()] + [(m, n, f) for m, t in (("audio", transforms.AUDIO_LADDER), ("video", transforms.VIDEO_LADDER)) for n, f in t.items()]
    return spark.createDataFrame(rows, "modality string, attack string, family string").groupBy("modality", "family").agg(F.count(F.lit(1)).cast("int").alias("n"))
