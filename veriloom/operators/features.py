"""Descriptor extraction: the interface, keyed projections and block hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions.stats import blockhash

#: Extractors by name: a function from a batch of raw items to one array for each.
EXTRACTORS: dict[str, Callable[[list[bytes]], list[list[float]]]] = {}


def register(name: str) -> Callable:
    """Add an extractor, such as a model or codec that this box does not have."""
    def add(f: Callable) -> Callable:
        EXTRACTORS[name] = f
        return f

    return add


def extract(items: DataFrame, method: str, key: str, content: str) -> DataFrame:
    """(key, vec): the descriptors of ``items`` by a registered extractor, in Arrow batches; a null item gives a null descriptor."""
    f = EXTRACTORS[method]

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            known = s.dropna()
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            if len(known):
                out.loc[known.index] = pd.Series([[float(x) for x in v] for v in f(known.tolist())], index=known.index, dtype=object)
            yield out

    return items.select(key, run(content).alias("vec"))


def signs(key: str, dim: int, bits: int) -> np.ndarray:
    """A matrix of 1 and -1 that belongs to ``key``: the parity of the first 60 bits of MD5 of ``key:i:b``."""
    return np.array([[1.0 if int(hashlib.md5(f"{key}:{i}:{b}".encode()).hexdigest()[:15], 16) % 2 else -1.0 for b in range(bits)] for i in range(dim)])


def keyed_code(vec: Column, key: str, dim: int, bits: int) -> Column:
    """Signs of a keyed random projection as an integer, bit b for projection b; null for a null vector or another length."""
    m = signs(key, dim, bits)

    @F.pandas_udf("bigint")
    def code(v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), dtype="Int64")
        ok = np.array([x is not None and len(x) == dim for x in v], dtype=bool)
        if ok.any():
            p = np.round(np.stack([np.asarray(x, dtype=np.float64) for x in v[ok]]) @ m, 9) > 0
            out[ok] = (p @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64)
        return out

    return code(vec)


@register("blockhash")
def _blockhash(batch: list[bytes]) -> list[list[float]]:
    """Block hashes of square 8-bit grey images given as raw bytes."""
    out = []
    for b in batch:
        side = int(len(b) ** 0.5)
        out.append(blockhash(np.frombuffer(b[: side * side], np.uint8).reshape(side, side).astype(float) * 3).tolist())
    return out


def timed_extract(items: DataFrame, method: str, key: str, content: str) -> DataFrame:
    """(key, vec, cpu_ms): descriptors with the CPU time of each item; the time of an Arrow batch is shared by its items, without those of null items."""
    import time

    f = EXTRACTORS[method]

    @F.pandas_udf("vec array<double>, cpu_ms double")
    def run(s: pd.Series) -> pd.DataFrame:
        known = s.dropna()
        t = time.process_time()
        found = [[float(x) for x in v] for v in f(known.tolist())] if len(known) else []
        each = (time.process_time() - t) * 1000 / max(1, len(known))
        out = pd.DataFrame({"vec": pd.Series([None] * len(s), dtype=object, index=s.index), "cpu_ms": pd.Series([None] * len(s), dtype="float64", index=s.index)})
        if len(known):
            out.loc[known.index, "vec"] = pd.Series(found, index=known.index, dtype=object)
            out.loc[known.index, "cpu_ms"] = each
        return out

    return items.withColumn("__o", run(content)).select(key, "__o.vec", "__o.cpu_ms")
