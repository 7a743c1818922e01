"""Languages of documents and of the stretches of mixed ones.

A text's vector is the average of hashed subword embeddings, and a linear
softmax over it gives the language, trained by stochastic gradient descent in
numpy. Because both parts are linear, a word's share of the evidence is one
row of scores, and a text is cut into parts by a dynamic program over its words
in which every change of language has a cost; parts that are too short go to
their surroundings. The confidence of a stretch is the softmax of its mean
evidence times a power of its words; power and factor are fitted on stretches of
held-out texts, so a confidence is about the share of right answers, and results
below a confidence are rejected.

Training takes a bounded sample of labelled rows, ``Settings.train_rows`` for
each language; everything else covers all rows and whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.textnorm import repair

#: Names under which a language is labelled, without case and region.
LABELS = {
    "en": "en", "eng": "en", "english": "en",
    "de": "de", "deu": "de", "ger": "de", "german": "de", "deutsch": "de",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr",
    "es": "es", "spa": "es", "spanish": "es",
    "it": "it", "ita": "it", "italian": "it",
    "nl": "nl", "nld": "nl", "dut": "nl", "dutch": "nl",
    "pt": "pt", "por": "pt", "portuguese": "pt",
}

LANGUAGES = ("en", "de", "fr", "es", "it", "nl", "pt")
STRETCHES = "seg_no int, first_word int, n_words int, text_lang string, confidence double, n_stretches int, rejected boolean"

_LETTERS = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")


def label_code(c: Column) -> Column:
    """The two-letter code that a label names in any spelling (case, region, three letters, English name); null if it names no known language."""
    name = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]+)(?:[-_ ][a-z0-9]+)*$", 1)
    table = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.element_at(table, F.when(name.isin(*LABELS), name))


@dataclass
class Settings:
    """train_rows: labelled rows taken for each language. buckets, dim: size of the embedding. rounds: passes over the pieces. least: words of a stretch. change: cost of a change of language, in nats. reject: confidence below which a result is rejected."""

    train_rows: int = 220
    buckets: int = 1 << 15
    dim: int = 16
    rounds: int = 3
    rate: float = 2.0
    least: int = 20
    change: float = 10.0
    reject: float = 0.8
    seed: int = 5


def subwords(word: str, buckets: int) -> list[int]:
    """Hashed ids of the word and of its character n-grams of two to four letters."""
    w = f"<{word}>"
    grams = {w}
    for n in (2, 3, 4):
        grams.update(w[i : i + n] for i in range(len(w) - n + 1))
    return [zlib.crc32(g.encode()) % buckets for g in sorted(grams)]


def tokens(text: str) -> list[str]:
    return repair(text).split()


@dataclass
class Model:
    languages: list[str]
    settings: Settings
    scores: np.ndarray  # of each bucket, for each language
    bias: np.ndarray
    temperature: float = 1.0
    factor: float = 1.0
    power: float = 0.5
    _row: dict[str, int] = field(default_factory=dict)
    _table: np.ndarray | None = None
    _used: int = 0

    def raw(self, token: str) -> tuple[np.ndarray, int]:
        """Sum of the scores of a token's subwords, and their number."""
        ids = [i for part in _LETTERS.findall(token.lower()) for i in subwords(part, self.settings.buckets)]
        return (self.scores[ids].sum(0), len(ids)) if ids else (np.zeros(len(self.languages), np.float32), 0)

    def _add(self, token: str) -> int:
        """Row of a token's log probabilities; 0, which is neutral, for numbers and codes, -1 for a token that is no word."""
        if _DIGIT.search(token):
            return 0
        if not _LETTERS.search(token):
            return -1
        if self._used == len(self._table):
            self._table = np.concatenate([self._table, np.empty_like(self._table)])
        total, n = self.raw(token)
        z = (total / n + self.bias) / self.temperature
        p = np.exp(z - z.max())
        # A share of doubt, so that no single word outweighs its surroundings.
        self._table[self._used] = np.log(0.97 * p / p.sum() + 0.03 / len(p))
        self._row[token] = self._used
        self._used += 1
        return self._used - 1

    def evidence(self, words: list[str]) -> np.ndarray:
        """Log probabilities of the languages for each word of a text; numbers and codes are neutral, punctuation is left out."""
        if self._table is None or self._used > 400_000:  # memory, not result: dropped rows are computed again
            self._row = {}
            self._table = np.full((4096, len(self.languages)), -np.log(len(self.languages)), np.float32)
            self._used = 1
        get = self._row.get
        rows = [get(w, -9) for w in words]
        if -9 in rows:
            for k, r in enumerate(rows):
                if r == -9:
                    known = get(words[k], -9)  # the text may have brought the word before
                    rows[k] = self._add(words[k]) if known == -9 else known
        at = np.array(rows, dtype=np.int64)
        return self._table[at[at >= 0]]

    def stretches(self, text: str) -> list[tuple[int, int, str, float]]:
        """(first word, words, language, confidence) of the stretches of a text; none if it has no word with letters."""
        e = self.evidence(tokens(text))
        if not len(e) or not (e != e[:, :1]).any():
            return []
        parts = segment(e, self.settings.least, self.settings.change)
        out = []
        for first, n, lang in parts:
            p = self.confidences(e[first : first + n])
            out.append((first, n, self.languages[lang], float(p[lang])))
        return out

    def confidences(self, e: np.ndarray) -> np.ndarray:
        """Confidence of each language for a stretch with evidence ``e``. Neutral words do not count; neighbours are not independent, so evidence grows more slowly than words do."""
        known = (e != e[:, :1]).any(1)
        z = e[known].mean(0) if known.any() else e.mean(0)
        z = z * self.factor * max(1, int(known.sum())) ** self.power
        p = np.exp(z - z.max())
        return p / p.sum()


def segment(e: np.ndarray, least: int, change: float) -> list[tuple[int, int, int]]:
    """Stretches of words with log probabilities ``e``: (first, words, language).

    Words are first cut so that the sum of their log probabilities less
    ``change`` for each change of language is largest. Parts of fewer than
    ``least`` words then go to their surroundings, the shortest first: to both
    neighbours if these agree, else to the longer one. What is left of a text is
    one stretch at least, in the language with most evidence if every part was
    short.
    """
    n = len(e)
    total = np.cumsum(e, axis=0, dtype=np.float64)
    main = int(np.argmax(total[-1]))
    if n < 2 * least:
        return [(0, n, main)]
    lead = total - total[:, main : main + 1]
    low = np.minimum(np.minimum.accumulate(lead, axis=0), 0.0)
    rivals = [int(i) for i in np.flatnonzero((lead - low).max(0) > change)]
    if not rivals:
        return [(0, n, main)]
    langs = [main, *[i for i in rivals if i != main]]
    parts = _parts(e[:, langs].tolist(), change)
    while len(parts) > 1:
        k = min(range(len(parts)), key=lambda i: parts[i][1])
        first, size, _ = parts[k]
        if size >= least:
            break
        before, after = parts[k - 1] if k else None, parts[k + 1] if k + 1 < len(parts) else None
        if before and after and before[2] == after[2]:
            parts[k - 1 : k + 2] = [(before[0], before[1] + size + after[1], before[2])]
        elif not after or before and before[1] >= after[1]:
            parts[k - 1 : k + 1] = [(before[0], before[1] + size, before[2])]
        else:
            parts[k : k + 2] = [(first, size + after[1], after[2])]
    if len(parts) == 1:
        return [(0, n, main)]
    return [(first, size, langs[k]) for first, size, k in parts]


def _parts(rows: list[list[float]], change: float) -> list[tuple[int, int, int]]:
    """Runs of the best sequence of languages: (first, words, column). Of equal sequences the one that stays longer is taken."""
    size = len(rows[0])
    value = list(rows[0])
    came: list[list[int]] = []
    for row in rows[1:]:
        top = max(range(size), key=value.__getitem__)
        jump = value[top] - change
        came.append([top if jump > value[k] else k for k in range(size)])
        value = [(jump if jump > value[k] else value[k]) + row[k] for k in range(size)]
    k = max(range(size), key=value.__getitem__)
    end, out = len(rows), []
    for i in range(len(rows) - 1, 0, -1):
        was = came[i - 1][k]
        if was != k:
            out.append((i, end - i, k))
            end, k = i, was
    out.append((0, end, k))
    return out[::-1]


def _pieces(texts: list[tuple[str, int]], settings: Settings, rng: np.random.Generator) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """Subword ids, label and text of pieces of 1 to 32 words."""
    cache: dict[str, list[int]] = {}
    ids, labels, owner = [], [], []
    for t, (text, label) in enumerate(texts):
        words = [w for w in tokens(text) if _LETTERS.search(w) and not _DIGIT.search(w)]
        at = 0
        while at < len(words):
            n = int(rng.choice((1, 2, 4, 8, 16, 32)))
            piece: list[int] = []
            for w in words[at : at + n]:
                if w not in cache:
                    cache[w] = [i for part in _LETTERS.findall(w.lower()) for i in subwords(part, settings.buckets)]
                piece += cache[w]
            ids.append(piece)
            labels.append(label)
            owner.append(t)
            at += n
    return ids, np.array(labels, dtype=np.int64), np.array(owner, dtype=np.int64)


def _averages(table: np.ndarray, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(i) for i in ids])
    flat = np.fromiter((x for i in ids for x in i), dtype=np.int64, count=int(size.sum()))
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    return np.add.reduceat(table[flat], starts, axis=0) / size[:, None], flat, size


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _descend(ids: list[list[int]], labels: np.ndarray, k: int, s: Settings, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    emb = rng.normal(0, 0.1, (s.buckets, s.dim)).astype(np.float32)
    out, bias = np.zeros((s.dim, k), np.float32), np.zeros(k, np.float32)
    out += rng.normal(0, 0.1, out.shape).astype(np.float32)
    batch, steps = 128, 0
    last = max(1, rounds * (len(ids) // batch + 1))
    for _ in range(rounds):
        order = rng.permutation(len(ids))
        for lo in range(0, len(ids), batch):
            at = order[lo : lo + batch]
            rate = s.rate * (1 - steps / last)
            steps += 1
            h, flat, size = _averages(emb, [ids[i] for i in at])
            g = _softmax(h @ out + bias)
            g[np.arange(len(at)), labels[at]] -= 1
            gh = (g @ out.T) / size[:, None]
            out -= rate * (h.T @ g) / len(at)
            bias -= rate * g.mean(0)
            uniq, inverse = np.unique(flat, return_inverse=True)
            grad = np.empty((len(uniq), s.dim), np.float32)
            rows = np.repeat(gh, size, axis=0)
            for d in range(s.dim):
                grad[:, d] = np.bincount(inverse, weights=rows[:, d], minlength=len(uniq))
            emb[uniq] -= rate * grad
    return emb @ out, bias


def fit(texts: list[tuple[str, str]], settings: Settings | None = None) -> Model:
    """Train on (text, language code) rows of which some may be wrong or mixed.

    A first pass finds pieces that contradict the label of their text; the second
    pass is trained without them. The temperature is fitted on held-out pieces.
    Languages without a row are never assigned. No rows at all are an error.
    """
    s = settings or Settings()
    rng = np.random.default_rng(s.seed)
    langs = [x for x in LANGUAGES if any(x == lang for _, lang in texts)]
    if not langs:
        raise ValueError("no labelled text to train on")
    ids, labels, owner = _pieces([(t, langs.index(lang)) for t, lang in texts], s, rng)
    if not ids:
        raise ValueError("no word in the labelled texts")
    held = owner % 10 == 0
    if held.all():
        held[:] = False
    learn = np.flatnonzero(~held)
    scores, bias = _descend([ids[i] for i in learn], labels[learn], len(langs), s, 1, rng)
    logits = lambda rows: _averages(scores, [ids[i] for i in rows])[0] + bias
    p = _softmax(logits(learn))
    learn = learn[p[np.arange(len(learn)), labels[learn]] > 0.05]
    scores, bias = _descend([ids[i] for i in learn], labels[learn], len(langs), s, s.rounds, rng)
    temperature = 1.0
    if held.any():
        rows = np.flatnonzero(held)
        z = logits(rows)
        keep = _softmax(z)[np.arange(len(rows)), labels[rows]] > 0.01
        z, y = z[keep], labels[rows][keep]
        if len(y):
            loss = {t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in (0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0)}
            temperature = min(loss, key=loss.get)
    model = Model(langs, s, scores.astype(np.float32), bias.astype(np.float32), temperature)
    calibrate(model, [(t, langs.index(lang)) for i, (t, lang) in enumerate(texts) if i % 10 == 0])
    return model


def held_out_stretches(model: Model, texts: list[tuple[str, int]]) -> list[tuple[np.ndarray, int]]:
    """(evidence, language) of stretches of 1 to 64 words of the texts that are wholly in the language of their label."""
    out = []
    for text, label in texts:
        e = model.evidence(tokens(text))
        if not len(e) or [p[2] for p in segment(e, model.settings.least, model.settings.change)] != [label]:
            continue
        lo, k = 0, len(out)
        while lo < len(e):
            n = (1, 2, 4, 8, 16, 32, 64)[k % 7]
            part = e[lo : lo + n]
            if (part != part[:, :1]).any():
                out.append((part, label))
            lo, k = lo + n, k + 1
    return out


def calibrate(model: Model, texts: list[tuple[str, int]]) -> None:
    """Choose ``factor`` and ``power`` under which stretches of ``texts`` have the least mean loss; kept as they are without any."""
    parts = held_out_stretches(model, texts)
    if not parts:
        return
    n = np.array([(e != e[:, :1]).any(1).sum() for e, _ in parts], dtype=np.float64)
    mean = np.stack([e[(e != e[:, :1]).any(1)].mean(0) for e, _ in parts]).astype(np.float64)
    y = np.array([label for _, label in parts])
    loss = {(f, q): -np.log(_softmax(mean * f * (n**q)[:, None])[np.arange(len(y)), y] + 1e-9).mean() for f in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0) for q in (0.0, 0.25, 0.5, 0.75, 1.0)}
    model.factor, model.power = min(loss, key=loss.get)


def reliability(model: Model, texts: list[tuple[str, str]], edges: tuple[float, ...] = (0.0, 0.5, 0.7, 0.8, 0.9, 0.95, 0.99, 1.0)) -> list[tuple[float, float, int, float, float]]:
    """(from, to, stretches, mean confidence, share right) of the stretches of labelled texts that the model has not seen."""
    parts = held_out_stretches(model, [(t, model.languages.index(lang)) for t, lang in texts if lang in model.languages])
    p = [float(model.confidences(e).max()) for e, _ in parts]
    right = [int(model.confidences(e).argmax()) == y for e, y in parts]
    out = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        at = [k for k, x in enumerate(p) if lo < x <= hi]
        if at:
            out.append((lo, hi, len(at), float(np.mean([p[k] for k in at])), float(np.mean([right[k] for k in at]))))
    return out


def sample(documents: DataFrame, settings: Settings, key: str, text: str, label: str) -> list[tuple[str, str]]:
    """At most about ``train_rows`` labelled texts of each language, chosen by the hash of their key."""
    known = documents.select(F.col(key).alias("k"), F.col(text).alias("t"), label_code(F.col(label)).alias("lang")).where(F.col("lang").isNotNull() & F.col("t").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, int(min(1.0, settings.train_rows / n) * (1 << 20))).otherwise(share)
    taken = known.where(F.pmod(F.xxhash64("k", F.lit(5)), F.lit(1 << 20)) < share).select("k", "t", "lang").collect()
    return [(r["t"], r["lang"]) for r in sorted(taken, key=lambda r: (str(r["k"]), r["t"]))]


def languages(documents: DataFrame, settings: Settings | None = None, key: str = "doc_id", text: str = "text", label: str = "lang", model: Model | None = None) -> DataFrame:
    """(key, label, seg_no, first_word, n_words, text_lang, confidence, n_stretches, rejected): the stretches of every text.

    A stretch with a confidence below ``reject`` is ``rejected``: its language is
    the likeliest of those known, but it may well be another one.

    ``label`` is the code that the row's label names, null if none. Stretches are
    numbered from 1 in text order; words are blank-separated tokens with a letter
    or digit. A null or blank text, or one without letters, has no stretch. Rows
    with the same key are looked at one by one.
    """
    settings = settings or Settings()
    model = model or fit(sample(documents, settings, key, text, label), settings)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            at: list[int] = []
            out: list[tuple[int, int, int, str, float, int, bool]] = []
            for r, t in enumerate(batch.column(2).to_pylist()):
                found = m.stretches(t)
                for no, (first, n, lang, p) in enumerate(found, 1):
                    at.append(r)
                    out.append((no, first, n, lang, p, len(found), p < settings.reject))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.bool_())
            rows = pa.array(at, pa.int64())
            arrays = [batch.column(0).take(rows), batch.column(1).take(rows), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, [key, "label", *[f.split()[0] for f in STRETCHES.split(", ")]])

    rows = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, label_code(F.col(label)).alias("label"), text)
    return rows.mapInArrow(run, f"`{key}` {kind}, label string, {STRETCHES}")


def relabelled(stretches: DataFrame, reject: float) -> DataFrame:
    """The rows of ``languages`` whose document has no known label, another language than its label, or several stretches.

    A single stretch whose confidence is below ``reject`` does not contradict a
    label.
    """
    wrong = (F.col("text_lang") != F.col("label")) & (F.col("confidence") >= reject)
    return stretches.where(F.col("label").isNull() | (F.col("n_stretches") > 1) | wrong)
