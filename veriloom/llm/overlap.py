"""Same or near-same records across splits.

Three joins give the pairs of an evaluation record and a training record:
canonical content hashes, binary codes within a Hamming radius, and vectors
above a cosine. Hashes are joined after case, punctuation and whitespace are
normalised. Codes are joined exactly: cut into more bands than the radius has
bits, two codes within the radius agree on a band, up to the few bits that the
query side flips. Vectors are found with the inverted multi-index. Equal codes,
and equal vectors, are one class in these searches; only the links that they
find are spread over the members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.similar import Space, similar_nodes, usable
from veriloom.plans.session import stage


def canonical_hash(c: Column) -> Column:
    """The 64 hex digits of a SHA-256 in any spelling, in lower case; null where there are none."""
    bare = F.regexp_replace(F.lower(c), r"^\W*sha-?256\W*|[^0-9a-z]", "")
    return F.when(bare.rlike("^[0-9a-f]{64}$"), bare)


def record_hash(*columns: Column) -> Column:
    """SHA-256 of a record's text fields after case, punctuation and whitespace are normalised; null if nothing is left.

    Punctuation counts as a blank, runs of blanks as one, and fields are told
    apart; a null field counts as an empty one.
    """
    bare = [F.trim(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " ")) for c in columns]
    text = F.concat_ws("\x1f", *bare)
    return F.when(F.length(F.replace(text, F.lit("\x1f"), F.lit(""))) > 0, F.sha2(text, 256))


def hash_pairs(records: DataFrame, key: str, digest: str, side: str) -> DataFrame:
    """(q, r): pairs of an evaluation key (``side`` true) and a training key (false) with equal canonical hashes.

    Null keys, sides and hashes take no part. Repeats count once.
    """
    rows = records.where(F.col(key).isNotNull() & F.col(side).isNotNull()).select(F.col(key).alias("k"), canonical_hash(F.col(digest)).alias("h"), F.col(side).alias("s")).where(F.col("h").isNotNull()).distinct()
    q, r = rows.where("s").select("h", F.col("k").alias("q")), rows.where(~F.col("s")).select("h", F.col("k").alias("r"))
    return q.join(r, "h").select("q", "r").distinct()


def _band(words: Column, start: int, width: int) -> Column:
    """Bits ``start`` to ``start + width`` of a code given as 64-bit words, lowest bit first."""
    word, shift = divmod(start, 64)
    low = F.shiftrightunsigned(words[word], shift)
    if shift + width > 64:
        low = low.bitwiseOR(F.shiftleft(words[word + 1], 64 - shift))
    return low.bitwiseAND(F.lit((1 << width) - 1))


def code_pairs(codes: DataFrame, key: str, words: str, side: str, bits: int, radius: int, flips: int | None = None) -> DataFrame:
    """(q, r): pairs of an evaluation key and a training key of which some codes are within ``radius`` bits.

    Exact. With f ``flips`` on the query side, radius // (f + 1) + 1 bands are
    needed, of about bits / bands bits each; no flips suit up to some millions of
    training codes, one flip, chosen by their number if not given, more. Codes
    that are null, hold a null word or have another number of words than
    ``bits`` needs take no part, nor do null keys and sides.
    """
    n_words = (bits + 63) // 64
    w = F.col(words)
    fine = F.col(key).isNotNull() & F.col(side).isNotNull() & (F.size(w) == n_words) & ~F.exists(w, lambda x: x.isNull())
    rows = codes.where(fine).select(F.col(key).alias("k"), F.col(side).alias("s"), *[w[i].alias(f"w{i}") for i in range(n_words)]).distinct()
    if flips is None:
        flips = 0 if rows.where(~F.col("s")).count() < 1 << 22 else 1
    bands = radius // (flips + 1) + 1
    edges = [bits * i // bands for i in range(bands + 1)]
    parts = F.array(*[F.struct(F.lit(i).cast("smallint").alias("band"), _band(F.array(*[F.col(f"w{j}") for j in range(n_words)]), edges[i], edges[i + 1] - edges[i]).alias("bits")) for i in range(bands)])
    names = [f"w{i}" for i in range(n_words)]
    # Distinct codes are searched; a code on both sides is filed on both.
    filed = rows.select("s", *names).distinct().select("s", *names, F.explode(parts).alias("p")).select("s", *names, "p.band", "p.bits")
    q, r = filed.where("s"), filed.where(~F.col("s"))
    if flips:
        width = max(b - a for a, b in zip(edges, edges[1:], strict=False))
        flipped = F.transform(F.sequence(F.lit(0), F.lit(width)), lambda i: F.when(i == 0, F.col("bits")).otherwise(F.col("bits").bitwiseXOR(F.pow(F.lit(2.0), (i - 1).cast("double")).cast("bigint"))))
        q = q.withColumn("bits", F.explode(flipped))
    q = q.select("band", "bits", *[F.col(n).alias(f"q_{n}") for n in names])
    r = r.select("band", "bits", *[F.col(n).alias(f"r_{n}") for n in names])
    apart = sum((F.bit_count(F.col(f"q_{n}").bitwiseXOR(F.col(f"r_{n}"))) for n in names[1:]), F.bit_count(F.col("q_w0").bitwiseXOR(F.col("r_w0"))))
    linked = q.join(r, ["band", "bits"]).where(apart <= radius).drop("band", "bits").distinct()
    of_q = rows.where("s").select(F.col("k").alias("q"), *[F.col(n).alias(f"q_{n}") for n in names])
    of_r = rows.where(~F.col("s")).select(F.col("k").alias("r"), *[F.col(n).alias(f"r_{n}") for n in names])
    return linked.join(of_q, [f"q_{n}" for n in names]).join(of_r, [f"r_{n}" for n in names]).select("q", "r").distinct()


def vector_pairs(vectors: DataFrame, key: str, vec: str, side: str, dim: int, least: float, probes: int = 96, **index: int) -> DataFrame:
    """(q, r): pairs of an evaluation key and a training key with a cosine of at least ``least``, by the inverted multi-index.

    Approximate, see ``similar``. Vectors that are not usable (null, wrong
    length, non-finite, all zero), null keys and sides take no part.
    """
    space = [Space("all", "ip", dim)]
    rows = usable(vectors.where(F.col(key).isNotNull() & F.col(side).isNotNull()).withColumn("__name", F.lit("all")), space, "__name", vec)
    rows = rows.select("__space", F.col(key).alias("item"), F.col(vec).cast("array<float>").alias("vec"), F.when(F.col(side), 1).otherwise(2).alias("sides"), F.col(side).alias("__side")).withColumn("node", F.xxhash64("vec"))
    found = similar_nodes(rows, space, [least], None, probes, "item", **index)
    pairs = found.select(F.when(F.col("a_sides") == 1, F.col("a")).otherwise(F.col("b")).alias("qn"), F.when(F.col("a_sides") == 1, F.col("b")).otherwise(F.col("a")).alias("rn"))
    q = rows.where("__side").select(F.col("node").alias("qn"), F.col("item").alias("q"))
    r = rows.where(~F.col("__side")).select(F.col("node").alias("rn"), F.col("item").alias("r"))
    # Equal vectors on both sides are one node and are not compared with themselves.
    pairs = pairs.distinct().join(q, "qn").join(r, "rn").select("q", "r")
    equal = q.join(r, q["qn"] == r["rn"]).select("q", "r")
    return pairs.unionByName(equal).distinct()


#: The sets of the corpus.
EVALUATION_SETS = ("dist", "neg", "hard")
TRAINING_SET = "reg"


def cross_split_pairs(items: DataFrame, membership: DataFrame, bits: DataFrame, vectors: DataFrame, methods: DataFrame) -> DataFrame:
    """(channel, q, r): pairs of an item of an evaluation set and an item of the training set that are the same or nearly so.

    channel is sha256, PDQ (within 16 bits) or SSCD-mixup (cosine of at least
    0.80). An item is not paired with itself.
    """
    def side(c: str) -> Column:
        return F.when(F.col(c).isin(*EVALUATION_SETS), True).when(F.col(c) == TRAINING_SET, False)

    dims = {r["method"]: r["dim"] for r in methods.where(F.col("method").isin("PDQ", "SSCD-mixup")).select("method", "dim").collect()}
    sided = membership.select("item_id", side("set_name").alias("side")).where(F.col("side").isNotNull()).distinct()
    hashed = items.select("item_id", "sha256").where(F.col("sha256").isNotNull()).join(sided, "item_id")
    pdq = bits.where((F.col("method") == "PDQ") & (F.col("dim") == dims.get("PDQ", 256))).withColumn("side", side("set_name"))
    sscd = vectors.where(F.col("method") == "SSCD-mixup").withColumn("side", side("set_name"))
    found = (
        hash_pairs(hashed, "item_id", "sha256", "side").withColumn("channel", F.lit("sha256"))
        .unionByName(code_pairs(pdq, "item_id", "words", "side", dims.get("PDQ", 256), 16).withColumn("channel", F.lit("PDQ")))
        .unionByName(vector_pairs(sscd, "item_id", "vec", "side", dims.get("SSCD-mixup", 96), 0.80).withColumn("channel", F.lit("SSCD-mixup")))
    )
    return found.where(F.col("q") != F.col("r")).select("channel", "q", "r")


def overlap_found(items: DataFrame, membership: DataFrame, bits: DataFrame, vectors: DataFrame, methods: DataFrame) -> DataFrame:
    """(set_name, item_a, item_b): distinct pairs with the evaluation set of the pair's evaluation item."""
    pairs = cross_split_pairs(items, membership, bits, vectors, methods).select("q", "r").distinct()
    sets = membership.where(F.col("set_name").isin(*EVALUATION_SETS)).select(F.col("item_id").alias("q"), "set_name").distinct()
    return pairs.join(sets, "q").select("set_name", F.least("q", "r").alias("item_a"), F.greatest("q", "r").alias("item_b")).distinct()


def overlap_report(items: DataFrame, membership: DataFrame, bits: DataFrame, vectors: DataFrame, methods: DataFrame) -> DataFrame:
    """Counts by evaluation set and source of the evaluation item.

    (set_name, source, items, overlapping, pairs, by_hash, by_code, by_vector,
    flagged, flagged_right, flag_missing): items of the set, those with an
    overlap, their pairs, items found by each channel, items with the mark of an
    earlier cleanup, those marked that overlap, and overlapping ones not marked.
    """
    found = stage(cross_split_pairs(items, membership, bits, vectors, methods), "overlap")
    per_item = found.groupBy("q").agg(
        F.countDistinct("r").alias("n"), F.max((F.col("channel") == "sha256").cast("int")).alias("h"), F.max((F.col("channel") == "PDQ").cast("int")).alias("c"), F.max((F.col("channel") == "SSCD-mixup").cast("int")).alias("v")
    )
    sources = items.where(F.col("item_id").isNotNull()).groupBy(F.col("item_id").alias("q")).agg(F.max("source").alias("source"))
    sets = membership.where(F.col("set_name").isin(*EVALUATION_SETS) & F.col("item_id").isNotNull()).groupBy("set_name", F.col("item_id").alias("q")).agg(F.coalesce(F.max("flagged"), F.lit(False)).alias("flag"))
    rows = sets.join(sources, "q", "left").join(per_item, "q", "left")
    hit = F.col("n").isNotNull()
    total = lambda c: F.sum(c.cast("bigint"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.groupBy("set_name", "source").agg(
        F.count(F.lit(1)).alias("items"), total(hit).alias("overlapping"), total(zero("n")).alias("pairs"), total(zero("h")).alias("by_hash"), total(zero("c")).alias("by_code"), total(zero("v")).alias("by_vector"),
        total(F.col("flag")).alias("flagged"), total(F.col("flag") & hit).alias("flagged_right"), total(~F.col("flag") & hit).alias("flag_missing"),
    )
