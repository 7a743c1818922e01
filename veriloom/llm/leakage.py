"""Evaluation passages inside a corpus, by a generalised suffix automaton.

The normalised words of the evaluation items make one automaton. Corpus texts
are streamed through it word by word, tracking the longest match that ends at
each word. Every word that ends a match of ``least`` words or more is credited to
all items that hold its last ``least`` words, which the suffix links lead to. An item with
enough credit close together in a text is checked exactly: common runs are
chained in the order of both texts, and the chain must cover the wanted share
of the item's words. The credit asked for is a lower bound of what any such
chain earns, so no text is dropped before the check.

The items are the stated query set. They are cut into shards of bounded size,
one automaton each, which the corpus is streamed through in turn, so neither the
driver nor a task ever holds more than a shard.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.textnorm import located, words
from veriloom.plans.prefix import running_total
from veriloom.plans.session import stage


@dataclass
class Automaton:
    """Suffix automaton of several word sequences. State 0 is the empty match."""

    ids: dict[str, int] = field(default_factory=dict)
    nexts: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    least: int = 3
    top: list[int] = field(default_factory=list)

    def _state(self, length: int, nexts: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.nexts.append(nexts)
        self.link.append(link)
        return len(self.length) - 1

    def _step(self, last: int, w: int) -> int:
        there = self.nexts[last].get(w)
        if there is not None:  # the sequence so far occurred in an earlier one
            return there if self.length[there] == self.length[last] + 1 else self._split(last, there, w)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.nexts[p]:
            self.nexts[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.nexts[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def _split(self, p: int, q: int, w: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.nexts[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.nexts[p].get(w) == q:
            self.nexts[p][w] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[str]) -> None:
        last = 0
        for word in sequence:
            last = self._step(last, self.ids.setdefault(word, len(self.ids)))

    def finish(self) -> int:
        """Number the shortest matches of ``least`` words or more that the suffix links of each state lead to; returns how many there are.

        States with equal numbers end in the same ``least`` words. What holds a
        match of the state holds these words.
        """
        self.top, n = [-1] * len(self.length), 0
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            if self.length[s] >= self.least:
                up = self.link[s]
                if self.length[up] >= self.least:
                    self.top[s] = self.top[up]
                else:
                    self.top[s] = n
                    n += 1
        return n

    def track(self, sequence: list[str]) -> tuple[list[int], list[int], list[int]]:
        """(positions, lengths, numbers) of the words that end a match of ``least`` words or more: its greatest length, and the number of its last ``least`` words."""
        nexts, link, length, top, least = self.nexts, self.link, self.length, self.top, self.least
        at: list[int] = []
        size: list[int] = []
        number: list[int] = []
        add_at, add_size, add_number = at.append, size.append, number.append
        s = n = 0
        for i, w in enumerate(map(self.ids.get, sequence)):
            if w is None:
                s = n = 0
                continue
            t = nexts[s].get(w)
            if t is None:
                while t is None and s > 0:
                    s = link[s]
                    t = nexts[s].get(w)
                if t is None:
                    n = 0
                    continue
                n = length[s]
            s = t
            n += 1
            if n >= least:
                add_at(i)
                add_size(n)
                add_number(top[s])
        return at, size, number


@dataclass
class Settings:
    """share: of an item's words that a text must hold. least: words of the shortest
    run that a chain is made of. runs: part of the wanted words that must be in runs.

    between: words between two runs on one offset whose equal words count. gap: words of the text between two runs of a chain. excess, spread: a chain's
    part of the text may be longer than its part of the item by ``excess`` words,
    or by ``spread`` of the item's words where that is more. toll: words that a
    run must bring in where more than ``shift`` words were put in or left out
    before it, so that stock phrases do not add up. length: words of a verbatim
    run that is removed whatever its share. shard: characters of the items of one
    automaton.
    """

    share: float = 0.5
    least: int = 3
    runs: float = 0.6
    between: int = 12
    gap: int = 60
    excess: int = 70
    spread: float = 0.5
    toll: int = 4
    shift: int = 3
    length: int = 30
    shard: int = 2_000_000

    def room(self, words_of_item: int) -> int:
        return max(self.excess, math.ceil(self.spread * words_of_item))


def common_words(text: list[str], item: list[str], least: int) -> list[tuple[int, int]]:
    """(start in the text, start in the item) of all equal stretches of ``least`` words, in order."""
    at = defaultdict(list)
    for q, w in enumerate(zip(*[item[x:] for x in range(least)], strict=False)):
        at[w].append(q)
    return [(p, q) for p, w in enumerate(zip(*[text[x:] for x in range(least)], strict=False)) for q in at.get(w, ())]


def backed(runs: list[tuple[int, int, int]], wanted: int, settings: Settings) -> list[tuple[int, int, int]]:
    """The runs that are longer than ``toll``, hold all ``wanted`` words, or have another run within ``shift`` of their offset."""
    offsets = sorted(p - q for p, q, _ in runs)
    near = {o for o, before, after in zip(offsets, [None, *offsets], [*offsets[1:], None], strict=False) if (before is not None and o - before <= settings.shift) or (after is not None and after - o <= settings.shift)}
    return [r for r in runs if r[2] > settings.toll or r[2] >= wanted or r[0] - r[1] in near]


def longest_runs(hits: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """(start in the text, start in the item, words) of the longest common runs that ``hits`` make up, in order."""
    going: dict[int, list[int]] = {}
    runs = []
    for p, q in hits:
        run = going.get(p - q)
        if run and run[0] + run[2] - least + 1 == p:
            run[2] += 1
        else:
            going[p - q] = run = [p, q, least]
            runs.append(run)
    return [(p, q, n) for p, q, n in runs]


def chained(text: list[str], item: list[str], settings: Settings, hits: list[tuple[int, int]] | None = None) -> tuple[int, int, list[tuple[int, int]]]:
    """Words of ``item`` covered by the best chain of common runs, those of them in runs, and the chain's parts (first, end) of ``text``.

    A run of at most ``toll`` words with no other one on about its offset is left
    out. The runs follow each other in both sequences, with at most ``gap`` other
    words of the text between two of them, and the text's part exceeds the item's
    by at most ``Settings.room``. Equal words between two
    runs of which the second stands where the first would go on, at most
    ``between`` words later, count as well. The best chain has most words less ``toll`` for each
    place where more than ``shift`` words were put in or left out. ``hits`` are
    those of ``common_words``, if known.
    """
    least = settings.least
    runs = longest_runs(common_words(text, item, least) if hits is None else hits, least)
    runs = backed(runs, math.ceil(settings.share * len(item) - 1e-9), settings)
    gap, room = settings.gap, settings.room(len(item))
    longest = max((n for _, _, n in runs), default=0)
    # Of the best chain ending in each run: its value, words, words in runs, start in the text and item, and the run before.
    best: list[tuple[int, int, int, int, int, int]] = []
    for k, (p, q, n) in enumerate(runs):
        mine = (n, n, n, p, q, -1)
        for j in range(k - 1, -1, -1):
            pj, qj, nj = runs[j]
            if p - pj > gap + longest:
                break
            ej, fj = pj + nj, qj + nj
            if pj >= p or qj >= q or p - ej > gap:
                continue
            over = max(0, ej - p, fj - q)
            if over >= n:
                continue
            jump = (p - ej) - (q - fj)
            gain = n - over - (settings.toll if abs(jump) > settings.shift else 0)
            single = 0
            if jump == 0 and 2 < p - ej <= settings.between:
                single = sum(text[ej + x] == item[fj + x] for x in range(1, p - ej - 1))
            value, covered, inside, p0, q0, _ = best[j]
            if (p - p0) - (q - q0) > room:  # the run before may still begin a chain of its own
                value, covered, inside, p0, q0 = nj, nj, nj, pj, qj
                if jump > room:
                    continue
                alone = True
            else:
                alone = False
            if value + gain + single > mine[0]:
                mine = (value + gain + single, covered + n - over + single, inside + n - over, p0, q0, -2 - j if alone else j)
        best.append(mine)
    if not best:
        return 0, 0, []
    k = max(range(len(best)), key=lambda i: (best[i][0], -i))
    covered, inside, parts = best[k][1], best[k][2], []
    while k >= 0:
        p, _, n = runs[k]
        parts.append((p, p + n))
        k = best[k][5]
        if k < -1:
            p, _, n = runs[-2 - k]
            parts.append((p, p + n))
            break
    return covered, inside, parts[::-1]


class Finder:
    """The items of one shard with their automaton."""

    def __init__(self, items: list[tuple[object, str]], settings: Settings) -> None:
        self.settings = settings
        split = [(k, w) for k, t in items if (w := words(t))]
        self.keys = [k for k, _ in split]
        self.items = [w for _, w in split]
        self.automaton = Automaton(least=settings.least)
        for w in self.items:
            self.automaton.add(w)
        n = self.automaton.finish()
        tracked = [self.automaton.track(w)[2] for w in self.items]
        self.hits: list[dict[int, list[int]]] = [{} for _ in tracked]
        holders: list[list[int]] = [[] for _ in range(n)]
        places: list[list[int]] = [[] for _ in range(n)]
        for i, numbers in enumerate(tracked):
            for q, g in enumerate(numbers):
                holders[g].append(i)
                places[g].append(q)
                self.hits[i].setdefault(g, []).append(q)
        size = np.array([len(w) for w in self.items], dtype=np.int64)
        wanted = np.ceil(settings.share * size - 1e-9)
        # ``runs`` of the wanted words must be in runs, and each run of n of them ends n - least + 1 matches, which is n / least at least.
        m = settings.least
        self.wanted, self.inside = wanted.astype(np.int64), np.ceil(settings.runs * wanted - 1e-9).astype(np.int64)
        self.need = np.maximum(1, np.ceil(self.inside / m)).astype(np.int64)
        self.width = size + np.array([settings.room(int(x)) for x in size], dtype=np.int64)
        # Words that many items share are not credited to those items that must earn as much credit elsewhere anyway.
        many = max(32, len(self.items) // 4)
        common = np.array([len(set(h)) > many for h in holders], dtype=bool)
        heavy = np.array([sum(common[g] for g in t) for t in tracked], dtype=np.int64)
        spared = self.need - heavy >= np.maximum(4, self.need // 2)
        self.need = np.where(spared, self.need - heavy, self.need)
        self.least = np.where(spared, self.inside - m * heavy, self.inside)
        kept = [[(i, q) for i, q in zip(h, where, strict=True) if not (c and spared[i])] for h, where, c in zip(holders, places, common.tolist(), strict=True)]
        self.starts = np.concatenate([[0], np.cumsum([len(h) for h in kept])]).astype(np.int64)
        flat = np.array([x for h in kept for x in h], dtype=np.int64).reshape(-1, 2)
        self.spared = spared
        self.slack = np.where((self.wanted <= settings.toll) | (settings.toll < m), 1 << 40, settings.shift)  # offsets within which a hit must have another one
        self.flat, self.place = np.ascontiguousarray(flat[:, 0]), np.ascontiguousarray(flat[:, 1])

    def candidates(self, tracked: list[tuple[list[int], list[int], list[int]]]) -> Iterator[tuple[int, int, list[tuple[int, int]] | None]]:
        """(text, item, hits) of the texts with enough credit for an item: hits are those of ``common_words`` that a chain can use, None if not all are known."""
        many = len(self.items)
        if not many or not any(a for a, _, _ in tracked):
            return
        text = np.repeat(np.arange(len(tracked)), [len(a) for a, _, _ in tracked])
        at = np.concatenate([np.array(a, dtype=np.int64) for a, _, _ in tracked])
        number = np.concatenate([np.array(g, dtype=np.int64) for _, _, g in tracked])
        starts = self.starts[number]
        times = self.starts[number + 1] - starts
        row = np.repeat(np.arange(len(at)), times)
        entry = np.arange(len(row)) + np.repeat(starts - np.cumsum(times) + times, times)
        item = self.flat[entry]
        pair = text[row] * many + item
        enough = np.flatnonzero(np.bincount(pair, minlength=len(tracked) * many)[pair] >= self.need[item])
        pair, item, word, place = pair[enough], item[enough], at[row[enough]] - self.settings.least + 1, self.place[entry[enough]]
        longest = max(map(len, self.items))
        reach = longest + max(map(len, (a for a, _, _ in tracked))) + int(word.max(initial=0)) + 2
        # Hits in the order of their offsets: those with another one near on the same text and item.
        key = pair * (4 * reach) + (word - place + 2 * reach)
        order = np.argsort(key)
        key, pair, item, word, place = key[order], pair[order], item[order], word[order], place[order]
        gap = np.diff(key, prepend=-(1 << 41), append=1 << 61)
        alike = np.append(False, pair[1:] == pair[:-1])
        slack = self.slack[item]
        near = (alike & (gap[:-1] <= slack)) | (np.append(alike[1:], False) & (gap[1:] <= slack)) | (slack > 1 << 30)
        pair, item, word, place = pair[near], item[near], word[near], place[near]
        enough = np.bincount(pair, minlength=len(tracked) * many)[pair] >= self.need[item]
        pair, item, word, place = pair[enough], item[enough], word[enough], place[enough]
        if not len(pair):
            return
        # Enough different words of the item.
        cut = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        ends = np.append(cut[1:], len(pair))
        rank = np.repeat(np.arange(len(cut)), ends - cut)
        step = max(1, 32_000_000 // longest)
        for lo in range(0, len(cut), step):
            a, b = cut[lo], ends[min(lo + step, len(cut)) - 1]
            seen = np.zeros((min(step, len(cut) - lo), longest + 1), dtype=bool)
            for x in range(self.settings.least):
                seen[rank[a:b] - lo, place[a:b] + x] = True
            for c in (lo + np.flatnonzero(seen.sum(1) >= self.least[item[cut[lo : lo + step]]])).tolist():
                i, part = int(item[cut[c]]), slice(cut[c], ends[c])
                yield int(pair[cut[c]]) // many, i, None if self.spared[i] else sorted(zip(word[part].tolist(), place[part].tolist(), strict=True))

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, list[tuple[int, int]]]]:
        """(text, item, share covered, parts of the text's words) of the items that the texts hold."""
        step = max(1, min(1024, 4_000_000 // max(1, len(self.items))))
        for lo in range(0, len(texts), step):
            split = [words(t) if t else [] for t in texts[lo : lo + step]]
            yield from ((lo + r, i, s, parts) for r, i, s, parts in self.match(split))

    def match(self, split: list[list[str]]) -> Iterator[tuple[int, int, float, list[tuple[int, int]]]]:
        """The same for texts given as words. Long texts are looked at in overlapping parts, each chain lying in one of them whole."""
        s = self.settings
        half = int(self.width.max(initial=256))
        parts = [(r, lo) for r, w in enumerate(split) for lo in range(0, max(1, len(w) - half), half)]
        texts = [split[r][lo : lo + 2 * half] for r, lo in parts]
        back = s.least - 1
        whole = [self.automaton.track(w) for w in split]
        tracked = []
        for r, lo in parts:
            at, size, number = whole[r]
            if lo or len(split[r]) > 2 * half:
                a, b = bisect_left(at, lo + back), bisect_left(at, lo + 2 * half)
                at, size, number = [p - lo for p in at[a:b]], size[a:b], number[a:b]
            tracked.append((at, size, number))
        for x, i, hits in self.candidates(tracked):
            r, lo = parts[x]
            item = self.items[i]
            if hits is None:
                held = self.hits[i]
                hits = [(p - back, q) for p, g in zip(tracked[x][0], tracked[x][2], strict=True) if g in held for q in held[g]]
            covered, inside, chain = chained(texts[x], item, s, hits)
            if covered >= self.wanted[i] and inside >= self.inside[i]:
                yield r, i, covered / len(item), [(a + lo, b + lo) for a, b in chain]


def shards(items: DataFrame, item_key: str, item_text: str, limit: int) -> Iterator[list[tuple[object, str]]]:
    """The distinct items in groups of about ``limit`` characters; sizes are summed by Spark before anything is collected."""
    rows = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).alias("k"), F.col(item_text).alias("t")).distinct()
    total = rows.agg(F.sum(F.length("t").cast("bigint"))).first()[0] or 0
    if total <= limit:
        yield [(r[0], r[1]) for r in rows.orderBy("k", "t").collect()]
        return
    cut = running_total(rows.withColumn("n", F.length("t").cast("bigint")), [], [F.col("k"), F.col("t")], "n", "upto")
    cut = stage(cut.select("k", "t", F.floor((F.col("upto") - F.col("n")) / limit).alias("shard")), "shards")
    for s in range(math.ceil(total / limit)):
        part = [(r[0], r[1]) for r in cut.where(F.col("shard") == s).select("k", "t").orderBy("k", "t").collect()]
        if part:
            yield part


def _scan(texts: DataFrame, items: DataFrame, settings: Settings, key: str, text: str, item_key: str, item_text: str) -> Iterator[tuple[DataFrame, object]]:
    """For each shard, the usable texts and the broadcast finder."""
    rows = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text)
    for part in shards(items, item_key, item_text, settings.shard):
        yield rows, texts.sparkSession.sparkContext.broadcast(Finder(part, settings))


def leaks(texts: DataFrame, items: DataFrame, settings: Settings | None = None, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_key, share): the evaluation items that each text holds, with the share of the item's words found.

    Null and empty texts and items hold and are held by nothing; an item of a
    single word is never found. Rows with the same key are looked at one by one,
    and a pair found twice comes once with its larger share.
    """
    settings = settings or Settings()
    kinds = dict(texts.dtypes)[key], dict(items.dtypes)[item_key]
    schema = f"`{key}` {kinds[0]}, `{item_key}` {kinds[1]}, share double"
    item_type = pa.int64() if kinds[1] == "bigint" else pa.int32() if kinds[1] == "int" else pa.string()

    def runner(shared):  # noqa: ANN001, ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = shared.value
            for batch in batches:
                found = [(r, f.keys[i], s) for r, i, s, _ in f.find(batch.column(1).to_pylist())]
                at, item, share = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, item_type), pa.array(share, pa.float64())], [key, item_key, "share"])

        return run

    found = None
    for rows, shared in _scan(texts, items, settings, key, text, item_key, item_text):
        part = rows.mapInArrow(runner(shared), schema)
        found = part if found is None else found.unionByName(part)
    return found.groupBy(key, item_key).agg(F.max("share").alias("share"))


def spans(texts: DataFrame, items: DataFrame, settings: Settings | None = None, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, begin, end): the characters of each text that stand in evaluation items, beyond the limits of share or length.

    Parts of a chain that covers ``share`` of an item go, and so does every
    verbatim run of at least ``length`` words. Words that were put into a
    quotation stay if they are more than ``shift``. Parts may overlap.
    """
    settings = settings or Settings()
    schema = f"`{key}` {dict(texts.dtypes)[key]}, begin int, end int"

    def runner(shared):  # noqa: ANN001, ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f, s = shared.value, settings
            for batch in batches:
                column = batch.column(1).to_pylist()
                at: list[int] = []
                begin: list[int] = []
                end: list[int] = []
                for r, t in enumerate(column):
                    if not t:
                        continue
                    w, where = located(t)
                    tracked = f.automaton.track(w)
                    parts = [(p - n + 1, p + 1) for p, n in zip(tracked[0], tracked[1], strict=True) if n >= s.length]
                    parts += [x for _, _, _, chain in f.match([w]) for x in chain]
                    for a, b in _joined(parts, s.shift):
                        at.append(r)
                        begin.append(where[a][0])
                        end.append(where[b - 1][1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], [key, "begin", "end"])

        return run

    found = None
    for rows, shared in _scan(texts, items, settings, key, text, item_key, item_text):
        part = rows.mapInArrow(runner(shared), schema)
        found = part if found is None else found.unionByName(part)
    return found


def _joined(parts: list[tuple[int, int]], near: int) -> list[tuple[int, int]]:
    """Parts (first, end) in order, with those that overlap or lie at most ``near`` apart joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a - out[-1][1] <= near:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def without_leaks(texts: DataFrame, items: DataFrame, settings: Settings | None = None, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, text, n_spans, removed_chars): every row of ``texts`` with the characters of ``spans`` taken out.

    Rows without such parts, null texts and null keys come out as they are, with
    0 spans. Keys must be distinct: the spans of a repeated key would be taken
    out of all of its rows.
    """
    found = spans(texts, items, settings, key, text, item_key, item_text)
    lists = found.groupBy(F.col(key).alias("__key")).agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("__spans"))
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str | None] = []
            n: list[int] = []
            gone: list[int] = []
            for t, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts = _joined([(c["begin"], c["end"]) for c in cuts or []], 0)
                n.append(len(parts))
                gone.append(sum(b - a for a, b in parts))
                if parts:
                    edges = [0, *[x for p in parts for x in p], len(t)]
                    t = re.sub(r"[ \t]{2,}", " ", " ".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))).strip()
                out.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(n, pa.int32()), pa.array(gone, pa.int32())], [key, text, "n_spans", "removed_chars"])

    rows = texts.select(key, text).join(lists, F.col(key) == F.col("__key"), "left").select(key, text, "__spans")
    return rows.mapInArrow(run, f"`{key}` {kind}, `{text}` string, n_spans int, removed_chars int")
