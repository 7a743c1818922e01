"""Connected groups by random-mate contraction, and splits that keep groups whole.

Each round every vertex draws a coin; a vertex with tails that has a neighbour
with heads collapses into it, by joins. Rounds go on until no edge is left.
The recorded collapses form a forest of at most as many levels as rounds; they
are unwound to the surviving vertex by joining the forest with itself, which
halves the levels each time. Nothing about single vertices reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.plans.prefix import running_total
from veriloom.plans.session import stage

MAX_ROUNDS = 400


def _heads(v: Column, round_no: int) -> Column:
    return F.pmod(F.xxhash64(v, F.lit(round_no)), F.lit(2)) == 0


def _ordered(a: Column, b: Column, df: DataFrame) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col("a") != F.col("b")).distinct()


def contract(edges: DataFrame) -> DataFrame:
    """Component labels (v, label) of the vertices of ``edges`` (a, b) that do not label their own component.

    A vertex that survives all rounds is the label of its component and has no
    row. Loops and repeated edges are ignored, and edges with a null end link
    nothing. The labels depend on the vertices and edges only.
    """
    spark = edges.sparkSession
    left = stage(_ordered(F.col("a"), F.col("b"), edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())), "edges")
    forest: DataFrame | None = None
    for r in range(MAX_ROUNDS):
        if left.isEmpty():
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tails_to_heads = both.where(~_heads(F.col("a"), r) & _heads(F.col("b"), r))
        mates = stage(tails_to_heads.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")), "mates")
        ma, mb = mates.select(F.col("v").alias("a"), F.col("p").alias("pa")), mates.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = left.join(ma, "a", "left").join(mb, "b", "left")
        left = stage(_ordered(F.coalesce("pa", "a"), F.coalesce("pb", "b"), moved), "edges")
        forest = mates if forest is None else forest.unionByName(mates)
    else:
        raise RuntimeError(f"edges are left after {MAX_ROUNDS} rounds")
    if forest is None:
        return spark.createDataFrame([], "v string, label string")
    levels = r
    while levels > 1:  # each vertex collapsed once, so the forest has one row for each v
        up = forest.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        forest = stage(forest.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p")), "forest")
        levels = (levels + 1) // 2
    return forest.withColumnRenamed("p", "label")


def group_labels(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Add ``label`` to ``members``, which have a vertex ``v``: the label of its component, ``v`` itself where nothing links it."""
    return members.join(contract(edges), "v", "left").withColumn("label", F.coalesce("label", "v"))


def weighted_splits(groups: DataFrame, plan: list[tuple[str, float]], label: str = "label", weight: str = "weight", giant: float = 0.01) -> DataFrame:
    """Assign whole groups to splits by their cumulative weight: (label, weight, split_name).

    Groups of over ``giant`` of the total weight come first, the heaviest ones
    ahead, and the others follow in the order of their labels' MD5; a group goes to the split in
    which its first unit of weight falls. ``plan`` has names and shares in order;
    the largest share comes first, so giants go there. Shares are scaled to
    their sum; an empty plan or one without positive shares is an error.
    """
    plan = sorted((p for p in plan if p[1] and p[1] > 0), key=lambda p: (-p[1], p[0]))
    if not plan:
        raise ValueError("a split plan needs a positive share")
    total = groups.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("t")).first()["t"]
    big = F.when(F.col(weight) > giant * float(total), F.col(weight)).otherwise(F.lit(0))
    keyed = groups.select(label, weight).withColumn("__big", big).withColumn("__h", F.md5(F.col(label).cast("string")))
    cum = running_total(keyed, [], [F.col("__big").desc(), F.col("__h"), F.col(label)], weight, "__upto")
    start = (F.col("__upto") - F.col(weight)).cast("double")
    whole, upto, name = sum(p[1] for p in plan), 0.0, None
    for split, share in plan:
        upto += share
        edge = start < F.lit(upto / whole * float(total))
        name = F.when(edge, F.lit(split)) if name is None else name.when(edge, F.lit(split))
    return cum.select(label, weight, name.otherwise(F.lit(plan[-1][0])).alias("split_name"))


SRC_ID = r"(?:^|[^a-z0-9])(p[a-z0-9]{8})(?:[^a-z0-9]|$)"
#: What stands for a missing author.
NO_AUTHOR = ("", "-", "n/a", "unknown")


def source_id(c: Column) -> Column:
    """The id of nine characters in a spelling of a source, in lower case; null where there is none."""
    found = F.regexp_extract(F.lower(c), SRC_ID, 1)
    return F.when(found != "", found)


def author_key(c: Column) -> Column:
    """Authors without case and outer blanks; null for missing and placeholder authors."""
    a = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(~a.isin(*NO_AUTHOR), a)


def edit_groups(edits: DataFrame, config_items: DataFrame) -> DataFrame:
    """(edit_id, src, v, label) of each distinct edit: edits that share a source, an author or a clip, directly or through others, share ``label``.

    Rows of one edit_id count once (their largest src and author). An edit with
    neither src nor author is a group of its own. A null edit_id is dropped.
    """
    e = (
        edits.where(F.col("edit_id").isNotNull())
        .select("edit_id", source_id(F.col("src")).alias("src"), author_key(F.col("author")).alias("author"))
        .groupBy("edit_id")
        .agg(F.max("src").alias("src"), F.max("author").alias("author"))
    )
    e = stage(e, "edits")
    s, a = F.concat(F.lit("S"), F.col("src")), F.concat(F.lit("A"), F.col("author"))
    by_author = e.select(s.alias("a"), a.alias("b"))
    by_clip = config_items.select(F.concat(F.lit("S"), source_id(F.col("item"))).alias("a"), F.concat(F.lit("C"), F.col("clip")).alias("b"))
    members = e.select("edit_id", "src", F.coalesce(s, a, F.concat(F.lit("E"), F.col("edit_id").cast("string"))).alias("v"))
    return group_labels(members, by_author.unionByName(by_clip))


def edit_splits(edits: DataFrame, config_items: DataFrame, plan: list[tuple[str, float]]) -> DataFrame:
    """(edit_id, split_name, label): every distinct edit with its split. ``label`` is the smallest vertex among the edits of its group."""
    labelled = stage(edit_groups(edits, config_items), "labelled")
    groups = stage(labelled.groupBy(F.col("label").alias("__label")).agg(F.count(F.lit(1)).alias("weight"), F.min("v").alias("label")), "groups")
    splits = weighted_splits(groups, plan).select("label", "split_name")
    named = groups.join(splits, "label").select("__label", "label", "split_name")
    return labelled.withColumnRenamed("label", "__label").join(named, "__label").select("edit_id", "split_name", "label")


def edit_group_sources(edits: DataFrame, config_items: DataFrame) -> DataFrame:
    """(edit_id, group_src): the smallest src among the edits of each edit's group; groups without src have no rows."""
    labelled = stage(edit_groups(edits, config_items), "labelled")
    names = labelled.where(F.col("src").isNotNull()).groupBy("label").agg(F.min("src").alias("group_src"))
    return labelled.join(names, "label").select("edit_id", "group_src")
