"""Payload statistics, gates, ranking and cost of media watermarks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions import stats


def equal_bits(a: Column, b: Column, nbits: int) -> Column:
    """Equal bits of two payloads of ``nbits`` bits given as arrays of bits; 0 for a null or short one."""
    same = F.aggregate(F.zip_with(F.slice(a, 1, nbits), F.slice(b, 1, nbits), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() | b.isNull() | (F.size(a) < nbits) | (F.size(b) < nbits), 0).otherwise(same)


def word_matches(a: Column, b: Column, nbits: int) -> Column:
    """Equal bits of two payloads held in one 64-bit word; 0 for a null one."""
    return F.coalesce(F.lit(nbits) - F.bit_count(a.bitwiseXOR(b)), F.lit(0))


def k_thresholds(nbits: DataFrame, column: str = "nbits", limit: float = 1e-6) -> DataFrame:
    """``nbits`` with ``k``: the matches that random bits reach with a probability of at most ``limit``; n + 1 where none does."""
    @F.pandas_udf("bigint")
    def k(n: pd.Series) -> pd.Series:
        known = {x: stats.k_of_n(int(x), limit) for x in n.dropna().unique()}
        return n.map(known).astype("Int64")

    return nbits.withColumn("k", k(F.col(column).cast("double")))


def tail_probability(rows: DataFrame, n: str, k: str, name: str = "tail") -> DataFrame:
    """``rows`` with the probability that n random bits match at least k times."""
    @F.pandas_udf("double")
    def tail(ns: pd.Series, ks: pd.Series) -> pd.Series:
        return pd.Series([stats.binom_tail(int(a), int(b)) if pd.notna(a) and pd.notna(b) else None for a, b in zip(ns, ks, strict=True)], dtype="float64")

    return rows.withColumn(name, tail(F.col(n).cast("double"), F.col(k).cast("double")))


def attack_block(attacks: DataFrame, k: Column, order: str) -> DataFrame:
    """(config, attack, n, bit_acc_mean, bit_acc_min, key_detect_rate, native_rate, exact_rate); means skip nulls and are null if all are.

    Each group is summed in ``order``, one row after the other: a sum of doubles
    depends on their order, and a mean halfway between two roundings shows it.
    """
    groups = ["config", "attack"]
    return attacks.repartition(*groups).sortWithinPartitions(*groups, order).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg("bit_acc").alias("bit_acc_mean"), F.min("bit_acc").alias("bit_acc_min"), F.avg((F.col("matches") >= k).cast("int")).alias("key_detect_rate"),
        F.avg(F.col("native_detect").cast("int")).alias("native_rate"), F.avg(F.coalesce(F.col("payload_exact"), F.col("matches") == F.col("nbits")).cast("int")).alias("exact_rate"),
    )


def false_match_block(trials: DataFrame, k: Column, groups: list[str]) -> DataFrame:
    """(groups, n_trials, hits, max_matches, mean_matches, own_hits, random_hits) of exploded key trials; trial 0 is the own key."""
    hit = (F.col("matches") >= k).cast("bigint")
    own = (F.col("trial") == 0).cast("bigint")
    return trials.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_trials"), F.sum(hit).alias("hits"), F.max("matches").alias("max_matches"), F.avg("matches").alias("mean_matches"), F.sum(hit * own).alias("own_hits"), F.sum(hit * (1 - own)).alias("random_hits"))


def by_source(trials: DataFrame, hit: Column, groups: list[str], source: str) -> DataFrame:
    """(groups, n_sources, hit_sources): sources of which any trial hits."""
    s = trials.groupBy(*groups, source).agg(F.max(hit.cast("int")).alias("__h"))
    return s.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_sources"), F.sum("__h").alias("hit_sources"))


def majority(frames: DataFrame, groups: list[str], value: str, every: int = 3, frame: str = "frame") -> DataFrame:
    """(groups, bit): the sign of the mean value over every ``every``-th frame; a mean of 0 gives 0."""
    return frames.where(F.pmod(F.col(frame), F.lit(every)) == 0).groupBy(*groups).agg((F.avg(value) > 0).cast("int").alias("bit"))


def psnr(mse: Column) -> Column:
    """Peak signal-to-noise ratio in dB for a peak of 1; 100 for no error."""
    return F.when(mse <= 0, F.lit(100.0)).otherwise(-10.0 * F.log10(mse))


def snr(signal: Column, noise: Column) -> Column:
    """Signal-to-noise ratio in dB of two energies, each of 1e-12 at least."""
    return 10.0 * F.log10(F.greatest(signal, F.lit(1e-12)) / F.greatest(noise, F.lit(1e-12)))


def gate(per_set: DataFrame, metas: DataFrame, robust: float = 0.95, fpr_limit: float = 1e-3) -> DataFrame:
    """``metas`` with pooled, worst_set, robust, fpr_used, fpr_ok and eligible.

    ``per_set`` has config, set_name, n and hits. A configuration is robust if
    the pooled rate and that of its worst set reach ``robust``; its native false
    positive rate is used if known, else that of its key; it is eligible if
    besides it is deployable and had no errors. A configuration without results
    is not robust.
    """
    pooled = per_set.groupBy("config").agg((F.sum("hits") / F.greatest(F.lit(1), F.sum("n"))).alias("pooled"), F.min(F.col("hits") / F.greatest(F.lit(1), F.col("n"))).alias("worst_set"))
    m = metas.join(pooled, "config", "left").withColumn("robust", F.coalesce((F.col("pooled") >= robust) & (F.col("worst_set") >= robust), F.lit(False)))
    m = m.withColumn("fpr_used", F.coalesce("native_fpr", "key_fpr"))
    m = m.withColumn("fpr_ok", F.coalesce(F.col("fpr_used") <= fpr_limit, F.lit(False)))
    return m.withColumn("eligible", F.col("robust") & F.col("fpr_ok") & F.coalesce("deployable", F.lit(False)) & (F.coalesce("errors", F.lit(0)) == 0))


def ordinal(rows: DataFrame, value: Column, name: str, *ties: str) -> DataFrame:
    """``rows`` with the ordinal position by ``value``, nulls last; equal values get different ranks by ``ties``.

    For tables of configurations, of which there are few: the order is one window.
    """
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(value.asc_nulls_last(), *[F.col(t) for t in ties])))


def rank_sum(configs: DataFrame, first: str, second: str, tie: str, key: str = "config") -> DataFrame:
    """``configs`` with the ranks by ``first`` and ``second``, their sum, and place: ordered by the sum, then by descending ``tie``."""
    r = ordinal(ordinal(configs, F.col(first), "rank_first", key), F.col(second), "rank_second", key)
    r = r.withColumn("rank_total", F.col("rank_first") + F.col("rank_second"))
    return r.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rank_total", F.col(tie).desc_nulls_last(), key)))


def runner_up(ranked: DataFrame, place: str = "place", family: str = "family", key: str = "config") -> DataFrame:
    """(role, config): the default is the first place, the runner-up the first of another family, else the second place."""
    one = ranked.orderBy(place).limit(1).select(F.col(key).alias("d"), F.col(family).alias("df"))
    rest = ranked.crossJoin(one).where(F.col(key) != F.col("d"))  # one row
    other = (F.col(family) != F.col("df")).cast("int")
    second = rest.orderBy(other.desc(), place).limit(1).select(F.lit("runner_up").alias("role"), F.col(key).alias("config"))
    return one.select(F.lit("default").alias("role"), F.col("d").alias("config")).unionByName(second)


def impute_by_group(rows: DataFrame, group: str, value: str) -> DataFrame:
    """``rows`` with nulls of ``value`` replaced by the median of their group; a group of nulls stays null."""
    return rows.withColumn(value, F.coalesce(F.col(value), F.median(value).over(Window.partitionBy(group))))


def combined_score(configs: DataFrame, parts: dict[str, float], name: str = "combined") -> DataFrame:
    """``configs`` with the weighted geometric mean of ``parts`` (column to weight), each of 1e-9 at least; null if a part is."""
    total = sum(parts.values())
    logs = sum((F.lit(w) * F.ln(F.greatest(F.col(c), F.lit(1e-9))) for c, w in parts.items()), F.lit(0.0))
    missing = F.lit(False)
    for c in parts:
        missing = missing | F.col(c).isNull()
    return configs.withColumn(name, F.when(~missing, F.exp(logs / total)))


def usd_per_unit(ms_per_unit: Column, units: float, usd_per_hour: float, share: float = 1.0) -> Column:
    """Cost of ``units`` units at ``ms_per_unit`` milliseconds each on ``share`` of an instance."""
    return ms_per_unit * units / 3_600_000.0 * usd_per_hour * share


def payload_bits(keys: DataFrame, index: str, nbits: int, salt: str = "payload") -> DataFrame:
    """``keys`` with ``bits``, the payload that belongs to (salt, index); a null index has null bits."""
    @F.pandas_udf("array<int>")
    def bits(i: pd.Series) -> pd.Series:
        return i.map(lambda x: stats.payload(nbits, int(x), salt).astype(int).tolist() if pd.notna(x) else None)

    return keys.withColumn("bits", bits(F.col(index).cast("double")))


def false_keys(decodes: DataFrame, registry: DataFrame, detected: Column, word: str = "decoded") -> DataFrame:
    """(n, detected, registered): unmarked decodes, those detected, and those detected whose payload is a registered key (column ``word``)."""
    known = registry.select(word).distinct().withColumn("__known", F.lit(True))
    d = decodes.withColumn("__d", F.coalesce(detected, F.lit(False))).join(known, word, "left")
    return d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__d").cast("bigint")).alias("detected"), F.sum((F.col("__d") & F.coalesce("__known", F.lit(False))).cast("bigint")).alias("registered"))
