"""Most similar vectors by an inverted multi-index.

Each vector is cut into two halves, each half is quantised with a codebook of
its own, and the pair of centroids names the cell in which the vector is
filed. A query walks through the pairs of centroids in the order of their
summed distances with a heap, and its entries are compared on all components.

The first half has many more centroids than the second: a walk then stays with
few first centroids, which decide where a vector has to be sent, and finds more
neighbours in as many cells.

Codebooks are trained on the driver on a sample of bounded size; everything
else covers all rows. Rows move once: a vector goes to the region, a group of
first centroids, of its own, and to those that its walk visits. Regions are as
many as keep their rows bounded, down to single first centroids, of which there
are in proportion to the square root of the rows. A first centroid that the
sample shows to be larger still is cut by second centroids, so that a query goes
only where its cells are, and a cell larger than that by the hash of its entries.

Vectors travel as 8-bit or 16-bit components with a scale and the length of the
rounding error of their own. Bounds hold with this error, and what is decided
is then computed from the stored vectors. Exact copies are one node: they are
merged within each input partition before the shuffle and again in the region,
so a vector that a third of the rows share is filed about once for each
partition.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.plans.session import stage

#: How many times as many centroids the first half has as the square root of the cells.
SKEW = 8
#: Rows up to which the nodes of found pairs are broadcast, 16 bytes each; beyond, they are shuffled.
BROADCAST_NODES = 1_000_000
MOVED = "space int, task int, home boolean, node bigint, sides int, cell int, probes binary, scale float, err float, code binary"
PAIRS = "space int, a bigint, b bigint, a_sides int, b_sides int, sim double"


@dataclass
class Space:
    """One collection of vectors that are compared with each other, with its codebooks."""

    name: str
    metric: str  # ip or l2
    dim: int
    books: tuple[np.ndarray, np.ndarray] | None = None
    tasks: np.ndarray | None = None  # first task of each first centroid
    blocks: np.ndarray | None = None  # tasks of each first centroid, by second centroid
    salts: dict[int, int] | None = None  # tasks of each cell that is too large for one, from a first task on
    salted: dict[int, int] | None = None


def nearest(x: np.ndarray, book: np.ndarray, entries: int = 16_000_000) -> np.ndarray:
    """The nearest row of ``book`` for each row of ``x``; at most about ``entries`` distances are held at once."""
    sq = (book * book).sum(1)
    step = max(1, entries // len(book))
    return np.concatenate([np.argmin(sq - 2.0 * (x[lo : lo + step] @ book.T), axis=1) for lo in range(0, len(x), step)])


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """``k`` centroids of the rows of ``x``; empty clusters keep their centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=k, replace=len(x) < k)].astype(np.float32)
    for _ in range(rounds):
        near = nearest(x, c)
        order = np.argsort(near, kind="stable")
        ids, starts = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order], starts, axis=0)
        c[ids] = sums / np.diff(np.append(starts, len(x)))[:, None]
    return c


def half_distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (book * book).sum(1) - 2.0 * (x @ book.T) + (x * x).sum(1)[:, None]


def walk(d1: list[float], d2: list[float], n: int) -> list[tuple[int, int]]:
    """The ``n`` pairs of positions in two ascending lists with the smallest sums, in order of the sums."""
    heap, out = [(d1[0] + d2[0], 0, 0)], []
    while heap and len(out) < n:
        _, i, j = heapq.heappop(heap)
        out.append((i, j))
        if j == 0 and i + 1 < len(d1):
            heapq.heappush(heap, (d1[i + 1] + d2[0], i + 1, 0))
        if j + 1 < len(d2):
            heapq.heappush(heap, (d1[i] + d2[j + 1], i, j + 1))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """A list array whose lists have equal lengths and no nulls, as float32 rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    return flat.reshape(len(column), -1)


def _normal(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "ip" else x


def usable(vectors: DataFrame, spaces: list[Space], space: str, vec: str, metric_of: Column | None = None) -> DataFrame:
    """The rows whose vector has its space's dim, finite components and, under ip, one that is not 0; adds ``__space``, the position in ``spaces``."""
    number = F.lit(None).cast("int")
    dim, ip = F.lit(None).cast("int"), F.lit(False)
    for i, s in enumerate(spaces):
        here = F.col(space) == s.name
        number, dim, ip = F.when(here, i).otherwise(number), F.when(here, s.dim).otherwise(dim), F.when(here, s.metric == "ip").otherwise(ip)
    v = F.col(vec)
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    return vectors.withColumn("__space", number).where(F.col("__space").isNotNull() & (F.size(v) == dim) & fine & (~ip | some))


def train(rows: DataFrame, spaces: list[Space], key: str, vec: str, occupancy: int, sample_rows: int, block_rows: int) -> None:
    """Fit the codebooks of ``spaces`` on a sample of each space chosen by the hash of the key, and lay out the tasks.

    The sample has at most about ``sample_rows`` rows, or four for each first
    centroid where that is more: these grow with the square root of the rows.
    """
    counts = {r["__space"]: r["n"] for r in rows.groupBy("__space").agg(F.count(F.lit(1)).alias("n")).collect()}
    ks = {}
    for i, n in counts.items():
        cells = max(4.0, n / occupancy)
        k1 = int(max(2, SKEW * math.sqrt(cells)))
        ks[i] = k1, int(max(2, cells / k1))
    share = F.lit(0)
    for i, k in ks.items():
        share = F.when(F.col("__space") == i, int(min(1.0, min(max(sample_rows, 4 * k[0]), 32 * k[0]) / counts[i]) * (1 << 30))).otherwise(share)
    taken = rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(1 << 30)) < share).select("__space", vec).toArrow()
    for i, s in enumerate(spaces):
        n, (k1, k2) = counts.get(i, 0), ks.get(i, (2, 2))
        mine = taken.filter(pa.compute.equal(taken["__space"], i)).column(vec).combine_chunks() if n else None
        x = _normal(_matrix(mine), s.metric) if mine is not None and len(mine) else np.ones((1, s.dim), dtype=np.float32)
        half = s.dim // 2
        s.books = (kmeans(x[:, :half], k1), kmeans(x[:, half:], k2, seed=4))
        layout(s, nearest(x[:, :half], s.books[0]), nearest(x[:, half:], s.books[1]), n / len(x), max(1, k1 // SKEW, math.ceil(n / block_rows)), block_rows)


def layout(s: Space, c1: np.ndarray, c2: np.ndarray, each: float, regions: int, block_rows: int) -> None:
    """Number the tasks, from the centroids of sampled vectors that stand for ``each`` vectors."""
    k1, k2 = len(s.books[0]), len(s.books[1])
    per_first = np.bincount(c1, minlength=k1) * each
    s.blocks = np.clip(np.ceil(per_first / block_rows), 1, k2).astype(np.int32)
    s.tasks = (np.arange(k1) % min(regions, k1)).astype(np.int32)
    upto = min(regions, k1)
    for c in np.flatnonzero(s.blocks > 1).tolist():
        s.tasks[c] = upto
        upto += int(s.blocks[c])
    s.salts, s.salted = {}, {}
    cells, count = np.unique(c1 * k2 + c2, return_counts=True)
    for cell, n in zip(cells.tolist(), (count * each).tolist(), strict=True):
        if n > 2 * block_rows:
            s.salts[cell], s.salted[cell] = upto, math.ceil(n / block_rows)
            upto += s.salted[cell]


def _assign(spaces: list[Space], probes: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind, most = (np.int8, 127) if bits == 8 else (np.int16, 32767)

    def rows_of(number: int, node: np.ndarray, sides: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        s = spaces[number]
        half = s.dim // 2
        sorted_d, sorted_c = [], []
        for part, book in ((x[:, :half], s.books[0]), (x[:, half:], s.books[1])):
            d = half_distances(part, book)
            m = min(probes, d.shape[1])
            near = np.argpartition(d, m - 1, axis=1)[:, :m]
            dist = np.take_along_axis(d, near, 1)
            order = np.argsort(dist, axis=1, kind="stable")
            sorted_d.append(np.take_along_axis(dist, order, 1).tolist())
            sorted_c.append(np.take_along_axis(near, order, 1))
        scale = np.maximum(np.abs(x).max(1), 1e-30).astype(np.float32) / most
        code = np.rint(x / scale[:, None]).astype(kind)
        err = np.linalg.norm(x - code.astype(np.float32) * scale[:, None], axis=1).astype(np.float32) * np.float32(1.02) + np.float32(1e-6)
        size = s.dim * bits // 8
        buf = code.tobytes()
        where, task, home, probe = [], [], [], []
        c1, c2 = sorted_c
        width = len(s.books[1])
        tasks, blocks, salts, salted = s.tasks.tolist(), s.blocks.tolist(), s.salts, s.salted
        for r in range(len(x)):
            visits: dict[int, list[int]] = {}
            one, two = c1[r].tolist(), c2[r].tolist()
            own = -1
            for i, j in walk(sorted_d[0][r], sorted_d[1][r], probes):
                a, b = one[i], two[j]
                cell = a * width + b
                if cell in salts:
                    parts = range(salts[cell], salts[cell] + salted[cell])
                    mine = salts[cell] + int(node[r]) % salted[cell]
                else:
                    mine = tasks[a] + b % blocks[a]
                    parts = (mine,)
                if own < 0:
                    own = mine  # the first cell of the walk is the vector's own
                for t in parts:
                    visits.setdefault(t, []).append(cell)
            for t, cells in visits.items():
                where.append(r)
                task.append(t)
                home.append(t == own)
                probe.append(np.array(cells, dtype=np.int32).tobytes())
        at = np.array(where, dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(at), number, dtype=np.int32)), pa.array(task, pa.int32()), pa.array(home, pa.bool_()),
                pa.array(node[at]), pa.array(sides[at]), pa.array((c1[at, 0] * width + c2[at, 0]).astype(np.int32)), pa.array(probe, pa.binary()), pa.array(scale[at]), pa.array(err[at]),
                pa.array([buf[r * size : (r + 1) * size] for r in where], pa.binary()),
            ],
            names=[f.split()[0] for f in MOVED.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        for batch in batches:
            number, node, sides = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__space", "node", "sides"))
            fresh = np.zeros(len(node), dtype=bool)
            for r, k in enumerate(zip(number.tolist(), node.tolist(), sides.tolist(), strict=True)):
                if k not in seen:
                    seen.add(k)
                    fresh[r] = True
            if len(seen) > 2_000_000:  # memory, not result: what comes again is merged in its region
                seen.clear()
            for i in np.unique(number[fresh]).tolist():
                at = np.flatnonzero(fresh & (number == i))
                step = max(64, min(4096, 16_000_000 // len(spaces[i].books[0])))
                for lo in range(0, len(at), step):
                    part = at[lo : lo + step]
                    x = _normal(_matrix(batch.column("vec").take(pa.array(part))), spaces[i].metric)
                    yield rows_of(i, node[part], sides[part].astype(np.int32), x)

    return run


def _decode(table: pa.Table, dim: int, bits: int) -> np.ndarray:
    code = table.column("code").combine_chunks()
    if isinstance(code, pa.ChunkedArray):
        code = pa.concat_arrays(code.chunks)
    raw = np.frombuffer(b"".join(code.to_pylist()), dtype=np.int8 if bits == 8 else np.int16).reshape(-1, dim)
    return raw.astype(np.float32) * table.column("scale").to_numpy().astype(np.float32)[:, None]


def _top(s: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of each row's ``k`` largest values that are at least ``least``; with ties at the cut, those of the lowest columns."""
    if s.shape[1] > k:
        cut = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
        hit = s >= np.maximum(cut, least)
        if (hit.sum(1) > k).any():
            above = s > cut
            room = k - (above & hit).sum(1, keepdims=True)
            tie = hit & ~above
            hit = (hit & above) | (tie & (np.cumsum(tie, axis=1) <= room))
        return np.nonzero(hit)
    return np.nonzero(s >= least)


def _best(a: np.ndarray, b: np.ndarray, v: np.ndarray, node: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest values of each ``a`` among the distinct pairs; with ties, those of the smallest nodes."""
    _, one = np.unique(a.astype(np.int64) * len(node) + b, return_index=True)
    a, b, v = a[one], b[one], v[one]
    order = np.lexsort((node[b], -v, a))
    a, b, v = a[order], b[order], v[order]
    starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
    return a[rank < k], b[rank < k], v[rank < k]


def _compare(spaces: list[Space], least: list[float], k: int | None, both_sides: bool, bits: int) -> Callable[[pa.Table], pa.Table]:
    names = [f.split()[0] for f in PAIRS.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        number = table.column("space")[0].as_py()
        s, low = spaces[number], least[number]
        node, sides = table.column("node").to_numpy(), table.column("sides").to_numpy()
        home = table.column("home").to_numpy(zero_copy_only=False)
        # Copies from several partitions become one row again.
        _, first = np.unique(np.stack([node, sides.astype(np.int64), home.astype(np.int64)]), axis=1, return_index=True)
        table, node, sides, home = table.take(pa.array(first)), node[first], sides[first], home[first]
        x = _decode(table, s.dim, bits)
        err = table.column("err").to_numpy()
        sq = (x * x).sum(1)
        cell = table.column("cell").to_numpy()
        probes = table.column("probes").to_pylist()
        count = np.array([len(p) // 4 for p in probes])
        asked = np.frombuffer(b"".join(probes), dtype=np.int32)
        asker = np.repeat(np.arange(len(node)), count)
        order = np.argsort(asked, kind="stable")
        asked, asker = asked[order], asker[order]
        filed = np.flatnonzero(home)
        filed = filed[np.argsort(cell[filed], kind="stable")]
        cells, starts = np.unique(cell[filed], return_index=True)
        ends = np.append(starts[1:], len(filed))
        lo, hi = np.searchsorted(asked, cells, "left"), np.searchsorted(asked, cells, "right")
        out = []
        for c in range(len(cells)):
            e_all, q_all = filed[starts[c] : ends[c]], asker[lo[c] : hi[c]]
            for qs in range(0, len(q_all), 2048):
                q = q_all[qs : qs + 2048]
                for es in range(0, len(e_all), 4096):
                    e = e_all[es : es + 4096]
                    sim = x[q] @ x[e].T
                    if s.metric != "ip":
                        sim = -np.sqrt(np.maximum(sq[q][:, None] + sq[e][None, :] - 2.0 * sim, 0.0))
                    sim += err[q][:, None] + err[e][None, :]  # the most that it can be
                    same = node[q][:, None] == node[e][None, :]
                    if both_sides:
                        same |= ((sides[q][:, None] & 1) & (sides[e][None, :] >> 1) | (sides[q][:, None] >> 1) & (sides[e][None, :] & 1)) == 0
                    sim[same] = -np.inf
                    if k is None:
                        found = [(np.nonzero(sim >= low), False)]
                    else:
                        found = [(_top(sim, k, low), False), (_top(sim.T, k, low), True)]
                    for (i, j), turned in found:
                        a, b = (e[i], q[j]) if turned else (q[i], e[j])
                        v = sim[j, i] if turned else sim[i, j]
                        ok = np.isfinite(v)
                        if ok.any():
                            out.append((a[ok], b[ok], v[ok]))
        a, b, v = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if k is not None and len(a):
            a, b, v = _best(a, b, v, node, k)
        return pa.Table.from_arrays([pa.array(np.full(len(a), number, dtype=np.int32)), pa.array(node[a]), pa.array(node[b]), pa.array(sides[a].astype(np.int32)), pa.array(sides[b].astype(np.int32)), pa.array(v.astype(np.float64))], names)

    return run


def similar_nodes(rows: DataFrame, spaces: list[Space], least: list[float], k: int | None, probes: int, key: str = "item_id", occupancy: int = 16, sample_rows: int = 65536, block_rows: int = 20000, bits: int = 8) -> DataFrame:
    """Similar nodes among ``rows`` (``__space``, ``node``, ``sides``, ``vec`` and the key), which must be ``usable``.

    ``node`` identifies a vector; copies share it. With ``k``, each node's
    ``k`` nearest in either direction at least come out, as (a, b) with a the
    one whose list it is; without, all pairs found come out once or twice.
    ``least`` is the smallest similarity wanted in each space: a cosine, or a
    negated distance. ``sides`` 0 compares all with all; otherwise bit 0 is only
    compared with bit 1. ``probes`` is the number of cells of a walk. ``bits`` of
    a component travel, 8 or 16. ``sim`` is computed from the stored vectors.
    """
    with_sides = rows.where(F.col("sides") > 0).limit(1).count() > 0
    train(rows, spaces, key, "vec", occupancy, sample_rows, block_rows)
    moved = rows.select("__space", "node", "sides", "vec").mapInArrow(_assign(spaces, probes, bits), MOVED)
    found = moved.groupBy("space", "task").applyInArrow(_compare(spaces, least, k, with_sides, bits), PAIRS)
    return measured(stage(found.groupBy("space", "a", "b").agg(F.max("a_sides").alias("a_sides"), F.max("b_sides").alias("b_sides")), "near"), rows, spaces, least)


def measured(pairs: DataFrame, rows: DataFrame, spaces: list[Space], least: list[float]) -> DataFrame:
    """``pairs`` (space, a, b, ...) with ``sim`` of the stored vectors, where it is at least ``least``.

    Only vectors of nodes in ``pairs`` move; their nodes are broadcast while they
    are few.
    """
    ends = pairs.select("space", F.col("a").alias("node")).union(pairs.select("space", F.col("b").alias("node")))
    nodes = stage(ends.distinct(), "nodes")
    small = nodes.count() <= BROADCAST_NODES
    wanted = nodes.withColumnRenamed("space", "__space")
    vectors = rows.join(F.broadcast(wanted) if small else wanted, ["__space", "node"], "left_semi").groupBy(F.col("__space").alias("space"), "node").agg(F.any_value("vec").alias("vec"))
    both = pairs.join(vectors.select("space", F.col("node").alias("a"), F.col("vec").alias("va")), ["space", "a"]).join(vectors.select("space", F.col("node").alias("b"), F.col("vec").alias("vb")), ["space", "b"])
    ip = np.array([s.metric == "ip" for s in spaces])
    low = np.array(least, dtype=np.float64)
    names = [f.split()[0] for f in PAIRS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            space = batch.column("space").to_numpy()
            sim = np.full(len(space), -np.inf)
            for i in np.unique(space).tolist():
                at = np.flatnonzero(space == i)
                a, b = (_matrix(batch.column(c).take(pa.array(at))).astype(np.float64) for c in ("va", "vb"))
                if ip[i]:
                    sim[at] = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
                else:
                    sim[at] = -np.sqrt(((a - b) ** 2).sum(1))
            keep = pa.array(sim >= low[space])
            sim = np.round(sim, 9) + 0.0  # equal to nine decimals is equal, and then the key decides
            columns = [batch.column(c) for c in ("space", "a", "b", "a_sides", "b_sides")]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in [*columns, pa.array(sim)]], names)

    return both.select("space", "a", "b", "a_sides", "b_sides", "va", "vb").mapInArrow(run, PAIRS)


def most_similar(vectors: DataFrame, spaces: list[Space], k: int, least: list[float], probes: int = 24, key: str = "item_id", space: str = "method", vec: str = "vec", spare: int = 6, **index: int) -> DataFrame:
    """The ``k`` most similar other keys of every key: (space, key, other, rank, sim).

    Repeats of a key count once; exact copies under other keys are the most
    similar ones of each other. Equal similarities are ordered by key, but where
    more than ``k`` different vectors are equally near, those with the smallest
    hashes are listed. Regions give ``spare`` more than ``k``, of which the stored
    vectors decide. Vectors
    that are not ``usable`` and null keys take no part; a space without vectors
    has no rows. Approximate: a neighbour whose cell neither walk visits is
    missed.
    """
    fine = usable(vectors.where(F.col(key).isNotNull()), spaces, space, vec).select("__space", F.col(key).alias("item"), F.col(vec).cast("array<float>").alias("vec"), F.lit(0).alias("sides"))
    fine = fine.withColumn("node", F.xxhash64("vec"))
    found = similar_nodes(fine, spaces, least, k + spare, probes, "item", **index)
    turned = found.select("space", F.col("b").alias("a"), F.col("a").alias("b"), "sim")
    near = found.select("space", "a", "b", "sim").unionByName(turned).groupBy("space", "a", "b").agg(F.max("sim").alias("sim"))
    best = Window.partitionBy("space", "a").orderBy(F.col("sim").desc(), "b")
    near = near.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= k).drop("__r")
    members = fine.select(F.col("__space").alias("space"), "node", "item").distinct()
    # The k + 1 smallest keys of each node stand for it in the lists of others, and in its own.
    heads = members.withColumn("__r", F.row_number().over(Window.partitionBy("space", "node").orderBy("item"))).where(F.col("__r") <= k + 1).drop("__r")
    top = F.when(F.element_at(F.array(*[F.lit(s.metric == "ip") for s in spaces]), F.col("space") + 1), F.lit(1.0)).otherwise(F.lit(0.0))
    theirs = near.join(heads.withColumnRenamed("node", "b"), ["space", "b"]).select("space", F.col("a").alias("node"), "sim", "item")
    lists = heads.withColumn("sim", top).unionByName(theirs).groupBy("space", "node").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), F.col("item").alias("other")))), 1, k + 1).alias("lst"))
    lists = lists.where(F.size("lst") > 1)  # no list but of itself
    out = members.join(lists, ["space", "node"]).select("space", "item", F.posexplode(F.slice(F.filter("lst", lambda e: e["other"] != F.col("item")), 1, k)).alias("pos", "e"))
    names = F.element_at(F.array(*[F.lit(s.name) for s in spaces]), F.col("space") + 1)
    return out.select(names.alias(space), F.col("item").alias(key), F.col("e.other").alias("other"), (F.col("pos") + 1).alias("rank"), (-F.col("e.far")).alias("sim"))


def vector_spaces(methods: DataFrame) -> list[Space]:
    """The vector methods of the methods table: one row each, so as many as methods exist."""
    return [Space(r["method"], r["metric"], r["dim"]) for r in methods.where(F.col("metric").isin("ip", "l2") & (F.col("dim") > 1)).select("method", "metric", "dim").distinct().orderBy("method").collect()]
