"""Inverted-index joins with offset votes, and similarities of sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shingles(texts: DataFrame, key: str, text: str, words: int = 5) -> DataFrame:
    """(key, pos, hash): 60-bit MD5 hashes of the runs of ``words`` words, with the position of their first word from 0.

    Words are parted by whitespace, without case. A text of fewer words, a blank
    and a null one have no posting.
    """
    w = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    t = texts.where(F.col(text).isNotNull()).select(key, w.alias("__w")).where(F.size("__w") >= words)
    runs = F.transform(F.sequence(F.lit(0), F.size("__w") - words), lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("__w", i + 1, words), " ").alias("s")))
    return t.select(key, F.explode(runs).alias("r")).select(key, F.col("r.pos").alias("pos"), F.conv(F.substring(F.md5("r.s"), 1, 15), 16, 10).cast("bigint").alias("hash"))


def offset_votes(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """(query_id, ref_id, offset, votes): equal hashes of a query and a reference by the difference of their positions.

    Each side is first compacted to (id, pos, hash). Votes are summed before and
    after the shuffle; a query does not vote for itself.
    """
    q = queries.select("query_id", F.col("pos").alias("qp"), "hash").distinct()
    r = refs.select("ref_id", F.col("pos").alias("rp"), "hash").distinct()
    j = q.join(r, "hash").where(F.col("query_id") != F.col("ref_id"))
    return j.groupBy("query_id", "ref_id", (F.col("rp") - F.col("qp")).alias("offset")).agg(F.count(F.lit(1)).alias("votes"))


def best_candidates(votes: DataFrame, cells: int = 200, refs: int = 20) -> DataFrame:
    """(query_id, ref_id, offset, votes, rank): of each query's ``cells`` most voted (reference, offset) cells the best one of the first ``refs`` distinct references."""
    order = [F.col("votes").desc(), F.col("ref_id"), F.col("offset")]
    top = votes.withColumn("__c", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("__c") <= cells)
    one = top.withColumn("__r", F.row_number().over(Window.partitionBy("query_id", "ref_id").orderBy(*order))).where(F.col("__r") == 1)
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= refs).drop("__c", "__r")


def aligned_counts(votes: DataFrame) -> DataFrame:
    """(query_id, ref_id, count): the largest offset bin plus its two neighbours, the smallest offset winning ties."""
    best = Window.partitionBy("query_id", "ref_id").orderBy(F.col("votes").desc(), "offset")
    top = votes.withColumn("__r", F.row_number().over(best)).where(F.col("__r") == 1).select("query_id", "ref_id", F.col("offset").alias("__o"))
    return votes.join(top, ["query_id", "ref_id"]).where(F.abs(F.col("offset") - F.col("__o")) <= 1).groupBy("query_id", "ref_id").agg(F.sum("votes").alias("count"))


def sequence_similarity(q: DataFrame, r: DataFrame, offsets: DataFrame, around: int = 2, least: int = 20) -> DataFrame:
    """(query_id, ref_id, score): best share of equal bits of two sequences of 32-bit words over their offsets.

    An offset needs an overlap of min(``least``, words of the query); 0 where none
    has it. Offsets within ``around`` of those in ``offsets`` (query_id, ref_id,
    offset) are tried.
    """
    size = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("__nq"))
    tried = offsets.withColumn("__d", F.explode(F.sequence(F.lit(-around), F.lit(around)))).select("query_id", "ref_id", (F.col("offset") + F.col("__d")).alias("__o")).distinct()
    j = tried.join(q.select("query_id", F.col("pos").alias("qp"), F.col("word").alias("qw")), "query_id").withColumn("rp", F.col("qp") + F.col("__o")).join(r.select("ref_id", F.col("pos").alias("rp"), F.col("word").alias("rw")), ["ref_id", "rp"])
    per = j.groupBy("query_id", "ref_id", (F.col("rp") - F.col("qp")).alias("__off")).agg(F.sum(F.bit_count(F.col("qw").bitwiseXOR(F.col("rw")))).alias("__wrong"), F.count(F.lit(1)).alias("__n"))
    per = per.join(size, "query_id").withColumn("__s", F.when(F.col("__n") >= F.least(F.lit(least), F.col("__nq")), 1.0 - F.col("__wrong") / (32.0 * F.col("__n"))).otherwise(0.0))
    return per.groupBy("query_id", "ref_id").agg(F.greatest(F.lit(0.0), F.max("__s")).alias("score"))


def segment_alignment(pairs: DataFrame, votes: DataFrame) -> DataFrame:
    """(query_id, ref_id, score): best mean similarity of aligned segments at the voted offset or one beside it.

    ``pairs`` has query_id, ref_id, qp, rp and sim.
    """
    near = votes.withColumn("__d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).select("query_id", "ref_id", (F.col("offset") + F.col("__d")).alias("__o")).distinct()
    j = pairs.withColumn("__o", F.col("rp") - F.col("qp")).join(near, ["query_id", "ref_id", "__o"])
    return j.groupBy("query_id", "ref_id", "__o").agg(F.avg("sim").alias("__m")).groupBy("query_id", "ref_id").agg(F.max("__m").alias("score"))


def frame_share(q: DataFrame, r: DataFrame, small: float = 1e-3) -> DataFrame:
    """(query_id, ref_id, score): share of the query's frames with a match plus ``small`` times that of the reference's.

    ``q`` (query_id, pos, hash) and ``r`` (ref_id, pos, hash) have one hash for
    each frame, frames matching where hashes are equal. Frames of one id and hash
    are one counted row before they meet, so a common frame costs one row for each
    id that has it.
    """
    q, r = q.groupBy("query_id", "hash").agg(F.countDistinct("pos").alias("__q")), r.groupBy("ref_id", "hash").agg(F.countDistinct("pos").alias("__r"))
    nq, nr = q.groupBy("query_id").agg(F.sum("__q").alias("__nq")), r.groupBy("ref_id").agg(F.sum("__r").alias("__nr"))
    m = q.join(r, "hash").groupBy("query_id", "ref_id").agg(F.sum("__q").alias("__mq"), F.sum("__r").alias("__mr"))
    return m.join(nq, "query_id").join(nr, "ref_id").select("query_id", "ref_id", (F.col("__mq") / F.col("__nq") + small * F.col("__mr") / F.col("__nr")).alias("score"))


def simhash(tokens: DataFrame, key: str, token: str, bits: int = 32) -> DataFrame:
    """(key, code): each bit is set if the bit is set in more than half of the MD5 hashes of the key's tokens.

    Sums of +1 and -1 are aggregated before the shuffle, so a long text is not
    held by one task.
    """
    h = F.conv(F.substring(F.md5(token), 1, 15), 16, 10).cast("bigint")
    signs = [F.sum(F.when(F.shiftright("__h", i).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1)).alias(f"__b{i}") for i in range(bits)]
    s = tokens.where(F.col(token).isNotNull()).select(key, h.alias("__h")).groupBy(key).agg(*signs)
    code: Column = F.lit(0).cast("bigint")
    for i in range(bits):
        code = code + F.when(F.col(f"__b{i}") > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
    return s.select(key, code.alias("code"))


def mean_vectors(segments: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, vec): the mean of a key's vectors, of unit length (a length of 1e-12 at least counts)."""
    p = segments.where(F.col(key).isNotNull()).select(key, F.posexplode(vec).alias("__i", "__x")).groupBy(key, "__i").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    g = p.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__i", "__m"))).alias("__l"))  # as many entries as the vector has
    v = F.transform("__l", lambda e: e["__m"])
    length = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    return g.select(key, F.transform(v, lambda x: x / length).alias("vec"))
