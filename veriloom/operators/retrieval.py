"""Exact similarity search, near-duplicate evidence and registry joins.

Searches compare a stated query set with all references in blocks: references
are cut into blocks by hash, queries into chunks, and each pair of a block and
a chunk is one task of bounded size that keeps its own best results. No side is
broadcast and no pair of rows is materialised.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of references and of a chunk of queries.
BLOCK_ROWS = 50_000
CHUNK_ROWS = 10_000


def _matrix(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def scores(q: np.ndarray, r: np.ndarray, metric: str, dim: int) -> np.ndarray:
    """Similarities of all rows of ``q`` with all of ``r``, rounded to nine decimals.

    hamming: share of equal bits of ``dim``-bit codes in 64-bit words; ip: inner
    product; cosine: that of the vectors over their lengths; l2: negative
    Euclidean distance.
    """
    if metric == "hamming":
        apart = np.zeros((len(q), len(r)), np.int32)
        for k in range(q.shape[1]):
            apart += np.bitwise_count(q[:, k].view(np.uint64)[:, None] ^ r[:, k].view(np.uint64)[None, :])
        return np.round(1.0 - apart / dim, 9)
    if metric == "cosine":
        q, r = unit(q), unit(r)
    s = q @ r.T
    if metric == "l2":
        s = -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (r * r).sum(1)[None, :] - 2.0 * s, 0.0))
    return np.round(s, 9) + 0.0  # no negative zero


#: Queries and references of a tile of codes, whose words stay in the cache of a core, and of a tile of vectors.
CODES, VECTORS = (32, 4096), (512, 4096)


def _apart(q: np.ndarray, r: np.ndarray, work: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
    """Differing bits of codes that numpy broadcasts against each other; words are on the first axis. ``work``: arrays to use again, the last one for the result."""
    if work is None:
        shape = np.broadcast_shapes(q.shape[1:], r.shape[1:])
        work = tuple(np.empty(shape, t) for t in (np.uint64, np.uint8, np.uint8, np.uint16))
    differ, bits, some, total = work
    for k in range(0, len(q), 3):  # three words differ in 192 bits at most
        np.bitwise_count(np.bitwise_xor(q[k], r[k], out=differ), out=some)
        for x, y in zip(q[k + 1 : k + 3], r[k + 1 : k + 3], strict=True):
            np.add(some, np.bitwise_count(np.bitwise_xor(x, y, out=differ), out=bits), out=some)
        if k:
            np.add(total, some, out=total)
        else:
            np.copyto(total, some)
    return total


def _tiles(q: np.ndarray, r: np.ndarray):  # noqa: ANN202
    """(first query, first reference, differing bits) of one tile after the other, overwritten by the next."""
    work = [np.empty(CODES, t) for t in (np.uint64, np.uint8, np.uint8, np.uint16)]
    for lo in range(0, q.shape[1], CODES[0]):
        x = q[:, lo : lo + CODES[0], None]
        for to in range(0, r.shape[1], CODES[1]):
            y = r[:, None, to : to + CODES[1]]
            yield lo, to, _apart(x, y, tuple(w[: x.shape[1], : y.shape[2]] for w in work))


def _where(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(m), m.shape[1])


def _firsts(i: np.ndarray, j: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` entries of each i with the smallest d, then j, in that order."""
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    top = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
    return i[top], j[top], d[top]


def _nearest_codes(q: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, reference, differing bits) of the ``k`` nearest references of each query, the first ones among equals."""
    found = []
    for lo, to, d in _tiles(q, r):
        n = len(d)
        if not to:
            best, more = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16))], 0
            bar = np.full((n, 1), np.iinfo(np.uint16).max, np.uint16)  # what a reference must stay below
        if not to and d.shape[1] > k:
            i, j = _where(d <= (np.partition(d, k - 1, axis=1)[:, k - 1 : k] if k > 1 else d.min(axis=1, keepdims=True)))
        else:
            i, j = _where(d < bar)
        if len(i):
            best.append((i, j + to, d[i, j]))
            more += len(i)
        last = to + CODES[1] >= r.shape[1]
        if last or not to or more >= n * k:
            best, more = [_firsts(*(np.concatenate(x) for x in zip(*best, strict=True)), k)], 0
            i, _, d = best[0]
            full = np.bincount(i, minlength=n) == k
            bar[full, 0] = d[np.searchsorted(i, np.arange(n), side="right")[full] - 1]
        if last:
            found.append((best[0][0] + lo, *best[0][1:]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _near_codes(q: np.ndarray, r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, reference, differing bits) of all pairs that differ in ``most`` bits or fewer.

    Cut into ``most`` + 1 parts, the codes of such a pair agree in one part at
    least. Only pairs that agree in a part are compared, unless they are so many
    that comparing all takes less.
    """
    (words, n), n_refs = q.shape, r.shape[1]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16))]
    runs = []
    if 8 * (most + 1) < 2.0 ** (64 * words // (most + 1)):  # by far not all pairs agree in one of the parts, if bits are even
        bits = [np.unpackbits(np.ascontiguousarray(x.T).view(np.uint8), axis=1) for x in (q, r)]
        for part in np.array_split(np.arange(64 * words), most + 1):
            both = np.packbits(np.concatenate([b[:, part] for b in bits]), axis=1)
            if both.shape[1] > 8:
                both = np.unique(both, axis=0, return_inverse=True)[1].ravel()
            else:
                both = np.ascontiguousarray(np.pad(both, ((0, 0), (0, 8 - both.shape[1])))).view(np.uint64)[:, 0]
            x, y = both[:n], both[n:]
            order = np.argsort(y, kind="stable")
            y = y[order]
            runs.append((order, np.searchsorted(y, x, side="left"), np.searchsorted(y, x, side="right")))
    if not runs or 8 * sum(int((hi - lo).sum()) for _, lo, hi in runs) > n * n_refs:
        for lo, to, d in _tiles(q, r):
            i, j = _where(d <= most)
            found.append((i + lo, j + to, d[i, j]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    for order, first, end in runs:
        size = end - first
        upto = np.cumsum(size)
        cut = 0
        while cut < n:  # as many queries at once as have a million references, one at least
            to = max(cut + 1, int(np.searchsorted(upto, (upto[cut - 1] if cut else 0) + 1_000_000, side="right")))
            m = size[cut:to]
            i = np.repeat(np.arange(cut, to), m)
            j = order[np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[cut:to], m)]
            d = _apart(q[:, i], r[:, j])
            ok = d <= most
            found.append((i[ok], j[ok], d[ok]))
            cut = to
    i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
    once = np.unique(i * n_refs + j, return_index=True)[1]
    return i[once], j[once], d[once]


def _near_vectors(q: np.ndarray, r: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, reference, inner product to nine decimals) of all pairs with a product of at least ``least``.

    What single precision, with its largest possible error, leaves is computed
    in double precision. The first half of the columns and the lengths of the
    rest bound a product from above: where that rules nearly all pairs out, the
    whole product is not needed.
    """
    dim = q.shape[1]
    longest = [float(np.linalg.norm(x, axis=1).max()) for x in (q, r)]
    slack = 1e-9 + 2 * (dim + 8) * float(np.finfo(np.float32).eps) * longest[0] * longest[1] + 1e-30
    whole = [x.astype(np.float32) for x in (q, r)]
    half = dim // 2
    heads = [np.column_stack([x[:, :half], np.linalg.norm(x[:, half:], axis=1)]).astype(np.float32) for x in (q, r)] if least > 0 and dim >= 16 else None
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    work = np.empty(VECTORS[0] * VECTORS[1], np.float32)
    for lo in range(0, len(q), VECTORS[0]):
        for to in range(0, len(r), VECTORS[1]):
            for a, b in (heads, whole) if heads else (whole,):
                a1, b1 = a[lo : lo + VECTORS[0]], b[to : to + VECTORS[1]]
                s = np.matmul(a1, b1.T, out=work[: len(a1) * len(b1)].reshape(len(a1), len(b1)))
                i, j = _where(s >= np.float32(least - slack))
                if a is not whole[0] and len(i) <= 0.005 * s.size:
                    break
                heads = None  # from here on
            for at in range(0, len(i), 100_000):
                x, y = i[at : at + 100_000] + lo, j[at : at + 100_000] + to
                v = np.round(np.einsum("ij,ij->i", q[x], r[y]), 9) + 0.0
                ok = v >= least
                found.append((x[ok], y[ok], v[ok]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _kernel(metric: str, dim: int, k: int | None, least: float | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    kind = np.int64 if metric == "hamming" else np.float64

    def codes(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, r = (np.ascontiguousarray(x.view(np.uint64).T) for x in (q, r))
        value = np.round(1.0 - np.arange(64 * len(q) + 1) / dim, 9)  # by differing bits
        near = len(value) - 1 if least is None else int((value >= least).sum()) - 1
        if near < 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        i, j, d = _near_codes(q, r, near) if k is None else _nearest_codes(q, r, k)
        ok = d.astype(np.int64) <= near
        return i[ok], j[ok], value[d[ok]]

    def vectors(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if metric == "cosine":
            q, r = unit(q), unit(r)
        if k is None and metric != "l2" and max(np.abs(q).max(), np.abs(r).max()) < 1e15:  # false for NaN as well; squares stay in single precision
            return _near_vectors(q, r, least)
        at, to, val = [], [], []
        step = max(1, 4_000_000 // max(1, len(r)))
        for lo in range(0, len(q), step):
            s = scores(q[lo : lo + step], r, "ip" if metric == "cosine" else metric, dim)
            if k is not None and s.shape[1] > k:
                cut = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                i, j = np.nonzero(s >= cut)
            else:
                i, j = np.nonzero(np.ones_like(s, dtype=bool) if least is None else s >= least)
            v = s[i, j]
            if least is not None:
                ok = v >= least
                i, j, v = i[ok], j[ok], v[ok]
            if k is not None and len(i):
                order = np.lexsort((j, -v, i))
                i, j, v = i[order], j[order], v[order]
                starts = np.searchsorted(i, i, side="left")
                top = np.arange(len(i)) - starts < k
                i, j, v = i[top], j[top], v[top]
            at.append(i + lo)
            to.append(j)
            val.append(v)
        return np.concatenate(at), np.concatenate(to), np.concatenate(val)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "ref_id", "score"]
        if not len(left) or not len(right):
            return pa.Table.from_arrays([left.column("query_id").slice(0, 0), right.column("ref_id").slice(0, 0), pa.array([], pa.float64())], names)
        right = right.sort_by("ref_id")  # the first among equals is then the smallest
        q, r = np.ascontiguousarray(_matrix(left.column("query"), kind)), np.ascontiguousarray(_matrix(right.column("ref"), kind))
        at, to, val = (codes if metric == "hamming" else vectors)(q, r)
        return pa.Table.from_arrays([left.column("query_id").take(pa.array(at)), right.column("ref_id").take(pa.array(to)), pa.array(val)], names)

    return run


def _size(rows: DataFrame, key: str) -> tuple[int, int]:
    """Rows, and rows of the most frequent key; only keys are read and shuffled."""
    r = rows.groupBy(key).count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    return r["n"] or 0, r["most"] or 1


def _blocks(queries: DataFrame, refs: DataFrame, metric: str, dim: int, k: int | None, least: float | None, n_queries: int | None = None, n_refs: int | None = None) -> DataFrame:
    """``queries`` (query_id, query) against ``refs`` (ref_id, ref), both not null and of equal lengths."""
    schema = f"query_id {dict(queries.dtypes)['query_id']}, ref_id {dict(refs.dtypes)['ref_id']}, score double"
    # Where a pair takes little time, chunks are larger and references are copied to fewer of them.
    wide = 2 if metric == "hamming" and k is not None else 5 if k is None and metric != "l2" else 1
    return _pairs_of_blocks(queries, refs, n_queries, n_refs, wide).applyInArrow(_kernel(metric, dim, k, least), schema)


def _pairs_of_blocks(queries: DataFrame, refs: DataFrame, n_queries: int | None = None, n_refs: int | None = None, wide: int = 1):  # noqa: ANN202
    """Chunks of queries grouped with blocks of references, each pair of them once.

    A chunk has up to ``wide`` times CHUNK_ROWS queries where the pairs suffice
    for all cores.
    """
    cores = queries.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(1, math.ceil((refs.count() if n_refs is None else n_refs) / BLOCK_ROWS))
    n_chunks = max(1, math.ceil((queries.count() if n_queries is None else n_queries) / CHUNK_ROWS))
    n_chunks = max(math.ceil(n_chunks / wide), min(n_chunks, math.ceil(2 * cores / n_blocks)))
    q = queries.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(n_chunks))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    r = refs.withColumn("block", F.pmod(F.xxhash64("ref_id"), F.lit(n_blocks)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_chunks - 1).cast("bigint"))))
    # So many partitions that few get two pairs; by size, they would be joined.
    n = n_blocks * n_chunks * (3 if n_blocks * n_chunks < 1000 else 1)
    q, r = (x.repartition(n, "block", "chunk") for x in (q, r))
    return q.groupBy("block", "chunk").cogroup(r.groupBy("block", "chunk"))


def top_k(queries: DataFrame, refs: DataFrame, k: int, metric: str, dim: int) -> DataFrame:
    """(query_id, rank, ref_id, score): the ``k`` best references of each query, all of them if fewer; ties by ref_id.

    Null ids and vectors take no part. Vectors must have equal lengths. Rows with
    the same query_id are variants of one query and a reference counts with its
    best variant, as do rows with the same ref_id.
    """
    queries = queries.where(F.col("query_id").isNotNull() & F.col("query").isNotNull())
    refs = refs.where(F.col("ref_id").isNotNull() & F.col("ref").isNotNull())
    # Variants share the places of their reference: more rows than k are kept where they exist.
    (n_refs, most), (n_queries, many) = _size(refs, "ref_id"), _size(queries, "query_id")
    found = _blocks(queries, refs, metric, dim, k * most, None, n_queries, n_refs)
    if most > 1 or many > 1:
        found = found.groupBy("query_id", "ref_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "ref_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "ref_id", "score")


def count_above(queries: DataFrame, refs: DataFrame, bar: str, metric: str, dim: int) -> DataFrame:
    """(query_id, n): how many references score above each query's ``bar``, counted where they are compared.

    ``queries`` has one row for each query_id. Null ids, vectors and bars take no
    part; without references there are no rows.
    """
    q = queries.where(F.col("query_id").isNotNull() & F.col("query").isNotNull() & F.col(bar).isNotNull()).select("query_id", "query", F.col(bar).cast("double").alias("bar"))
    r = refs.where(F.col("ref_id").isNotNull() & F.col("ref").isNotNull())
    kind = np.int64 if metric == "hamming" else np.float64

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.Table.from_arrays([left.column("query_id").slice(0, 0), pa.array([], pa.int64())], ["query_id", "n"])
        x, y = np.ascontiguousarray(_matrix(left.column("query"), kind)), np.ascontiguousarray(_matrix(right.column("ref"), kind))
        at = left.column("bar").to_numpy()
        step = max(1, 4_000_000 // len(y))
        n = np.concatenate([(scores(x[lo : lo + step], y, metric, dim) > at[lo : lo + step, None]).sum(1) for lo in range(0, len(x), step)])
        return pa.Table.from_arrays([left.column("query_id"), pa.array(n.astype(np.int64))], ["query_id", "n"])

    found = _pairs_of_blocks(q, r).applyInArrow(run, f"query_id {dict(q.dtypes)['query_id']}, n bigint")
    return found.groupBy("query_id").agg(F.sum("n").alias("n"))


def scored_pairs(queries: DataFrame, refs: DataFrame, scorer: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int) -> DataFrame:
    """(query_id, rank, ref_id, score): the ``k`` best references of each query under an external ``scorer``.

    ``scorer`` gets two matrices and gives the scores of all rows of the one with
    all rows of the other, as a tool that compares two media does. Equal scores
    are ordered by ref_id. Null ids and vectors take no part.
    """
    q = queries.where(F.col("query_id").isNotNull() & F.col("query").isNotNull())
    r = refs.where(F.col("ref_id").isNotNull() & F.col("ref").isNotNull())

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "ref_id", "score"]
        if not len(left) or not len(right):
            return pa.Table.from_arrays([left.column("query_id").slice(0, 0), right.column("ref_id").slice(0, 0), pa.array([], pa.float64())], names)
        right = right.sort_by("ref_id")
        x, y = _matrix(left.column("query"), np.float64), _matrix(right.column("ref"), np.float64)
        step = max(1, 1_000_000 // len(y))
        at, to, val = [], [], []
        for lo in range(0, len(x), step):
            s = np.round(np.asarray(scorer(x[lo : lo + step], y), dtype=np.float64), 9)
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            at.append(np.repeat(np.arange(len(s)) + lo, best.shape[1]))
            to.append(best.ravel())
            val.append(np.take_along_axis(s, best, 1).ravel())
        return pa.Table.from_arrays([left.column("query_id").take(pa.array(np.concatenate(at))), right.column("ref_id").take(pa.array(np.concatenate(to))), pa.array(np.concatenate(val))], names)

    schema = f"query_id {dict(q.dtypes)['query_id']}, ref_id {dict(r.dtypes)['ref_id']}, score double"
    found = _pairs_of_blocks(q, r).applyInArrow(run, schema).groupBy("query_id", "ref_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "ref_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "ref_id", "score")


def within(queries: DataFrame, refs: DataFrame, least: float, metric: str, dim: int) -> DataFrame:
    """(query_id, ref_id, score): pairs with a score of at least ``least``, each once with its best score; an id does not match itself."""
    queries = queries.where(F.col("query_id").isNotNull() & F.col("query").isNotNull())
    refs = refs.where(F.col("ref_id").isNotNull() & F.col("ref").isNotNull())
    found = _blocks(queries, refs, metric, dim, None, least).where(F.col("query_id").cast("string") != F.col("ref_id").cast("string"))
    return found.groupBy("query_id", "ref_id").agg(F.max("score").alias("score"))


def hamming(q: list[Column], r: list[Column], dim: int) -> Column:
    """Share of equal bits of two codes given word by word, inside code generation."""
    apart = F.bit_count(q[0].bitwiseXOR(r[0]))
    for a, b in zip(q[1:], r[1:], strict=True):
        apart = apart + F.bit_count(a.bitwiseXOR(b))
    return 1.0 - apart / F.lit(float(dim))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def negative_l2(a: Column, b: Column) -> Column:
    return -F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)))


def rowwise(f: Callable[..., np.ndarray], *columns: Column) -> Column:
    """``f`` of vectors of equal lengths as a matrix, and of any further columns, in Arrow batches; a null vector gives null.

    Array functions of SQL would evaluate what a lambda takes from outside once
    for each element.
    """
    @F.pandas_udf("array<double>")
    def run(v: pd.Series, *rest: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), dtype=object)
        ok = v.notna().to_numpy()
        if ok.any():
            m = f(np.stack([np.asarray(x, dtype=np.float64) for x in v[ok]]), *[r[ok].to_numpy() for r in rest])
            out[ok] = pd.Series(list(m), index=out.index[ok], dtype=object)
        return out

    return run(*columns)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def normalised(v: Column) -> Column:
    """A vector over its length, which counts as 1e-12 at least; all vectors of a column need the same length."""
    return rowwise(unit, v)


def true_scores(queries: DataFrame, refs: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, ref_id, score): the inner product of each query with its true reference, also outside the top results."""
    return truth.join(queries, "query_id").join(refs, "ref_id").select("query_id", "ref_id", F.round(dot(F.col("query"), F.col("ref")), 9).alias("score"))


def flags(evidence: DataFrame, mode: str) -> DataFrame:
    """Items (item_id) that ``evidence`` (item_id, method, anchor_id) marks as near-duplicates.

    any: by one method; two: by two methods on the same anchor; none: never.
    """
    if mode == "any":
        return evidence.select("item_id").distinct()
    if mode == "two":
        return evidence.groupBy("item_id", "anchor_id").agg(F.countDistinct("method").alias("n")).where(F.col("n") >= 2).select("item_id").distinct()
    if mode == "none":
        return evidence.select("item_id").limit(0)
    raise ValueError(f"unknown mode {mode}")


def without(rows: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not flagged; a null key stays."""
    return rows.join(flagged.select(F.col(flagged.columns[0]).alias(key)), key, "left_anti")


def rewrite_aliases(found: DataFrame, aliases: DataFrame) -> DataFrame:
    """``found`` with each retrieved ``ref_id`` that is an alias replaced by the asset it stands for; ``aliases`` has (alias_id, ref_id), of which the smallest asset counts."""
    a = aliases.groupBy("alias_id").agg(F.min("ref_id").alias("__asset"))
    return found.join(a, found["ref_id"] == a["alias_id"], "left").withColumn("ref_id", F.coalesce("__asset", "ref_id")).drop("__asset", "alias_id")


def substitute(registry: DataFrame, marked: DataFrame, key: str, value: str) -> DataFrame:
    """``registry`` with the values of ``marked`` in place of its own where ``marked`` has the key."""
    m = marked.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    return registry.join(m, registry[key] == m["__k"], "left").withColumn(value, F.coalesce("__v", value)).drop("__k", "__v")
