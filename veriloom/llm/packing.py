"""Filling containers of fixed capacity with texts.

Texts longer than a container are cut into full containers and a remainder;
everything else stays whole. Full pieces have a container of their own without
the tree. Remainders and short texts, at most one a text, are packed by first-fit
decreasing with a tournament tree over the free space of the bins, independently
in randomised groups, so the work of a task is bounded by the group size whatever
the number and the length of the texts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: WordPunct: a longest run of letters, digits and underscores, or a longest run of other non-blank characters.
WORD = r"[\p{L}\p{N}_]"
OTHER = r"[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}]"


def token_count(text: Column) -> Column:
    """WordPunct tokens of a text; null for a null text, 0 for a blank one."""
    return F.regexp_count(text, F.lit(f"{WORD}+|{OTHER}+")).cast("bigint")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size. Sizes must be from 1 to ``capacity``; ties keep their order.

    The tree's leaves are the free spaces of the bins in order and each node
    holds the larger of its children, so the first bin with enough space is found
    by one descent.
    """
    n = len(sizes)
    leaves = 1
    while leaves < max(n, 1):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    out = np.empty(n, dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        need = int(sizes[i])
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        out[i] = node - leaves
        free[node] -= need
        while node > 1:
            node //= 2
            a, b = free[2 * node], free[2 * node + 1]
            top = a if a >= b else b
            if free[node] == top:
                break
            free[node] = top
    return out


def pack(sized: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens", group_rows: int = 4096, rows: int | None = None) -> DataFrame:
    """Assign texts, or their pieces, to containers: (key, piece_no, start_token, n_tokens, container).

    A text with more than ``capacity`` tokens becomes pieces 0, 1, ...: each but
    the last is ``capacity`` long and has a container of its own. Every other
    text is one piece. ``container`` is unique over the result. Null or zero
    sizes need no container and give no row. Keys should be distinct; a repeated
    key is packed once for each row. ``group_rows`` bounds the rows of a group.
    ``rows`` is the number of rows of ``sized``, counted if not given.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    n = sized.count() if rows is None else rows
    groups = max(1, math.ceil(n / group_rows))
    items = sized.where(F.col(size) > 0).select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("total"))
    items = items.withColumn("grp", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(groups)).cast("int"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "total"], kind="stable").reset_index(drop=True)
        g, total = int(pdf["grp"].iloc[0]), pdf["total"].to_numpy()
        n_full, left = total // capacity, total % capacity
        rest = np.flatnonzero(left)
        bins = first_fit_decreasing(left[rest], capacity)
        # Full pieces, one after the other, and then what is left.
        at = np.repeat(np.arange(len(total)), n_full)
        place = np.arange(len(at)) - np.repeat(np.cumsum(n_full) - n_full, n_full)
        row, piece = np.concatenate([at, rest]), np.concatenate([place, n_full[rest]]).astype(np.int64)
        tokens = np.concatenate([np.full(len(at), capacity), left[rest]]).astype(np.int64)
        name = [f"f-{g}-{r}-{p}" for r, p in zip(at.tolist(), place.tolist(), strict=True)] + [f"g-{g}-{b}" for b in bins.tolist()]
        return pd.DataFrame({"key": pdf["key"].to_numpy()[row], "piece_no": piece.astype(np.int32), "start_token": piece * capacity, "n_tokens": tokens, "container": name})

    kind = dict(sized.dtypes)[key]
    packed = items.groupBy("grp").applyInPandas(fill, f"key {kind}, piece_no int, start_token bigint, n_tokens bigint, container string")
    return packed.withColumnRenamed("key", key)
