"""Reading level of each document.

A linear ranker learns from pairs of graded documents which of two is the more
demanding, by syntax features and the words used; isotonic regression turns its
scores into levels. Only documents mainly of running prose have a level; what
prose looks like is learned from the graded documents against the others.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import _chunks, text_list

BUCKETS = 2048
DENSE = 13
SHAPE = 9
LEVELS = 5

# Each pattern begins with a literal, which the search then jumps to.
_TAG = re.compile(r"<[^<>]{1,200}>")
_LINK = re.compile(r"https?://\S+")
_CLOCK = re.compile(r"\[\d\d?:\d\d(?::\d\d)?\]")
_BULLET = re.compile(r"\n\s*(?:[|#>*•-]+|\(?[ivx\d]{1,4}\))")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_ZERO = re.compile(r"0(?:(?<=[^\W\d_]0)|(?=[^\W\d_]))")
_STOP = re.compile(r"[.!?…]+|\n\s*\n|;\s*\n")


def plain(text: str | None) -> str:
    """Lower case without markup, links, time marks, bullets and zeros that stand for the letter o."""
    if not text:
        return ""
    if "&" in text:
        text = html.unescape(text)
    for mark, pattern in (("<", _TAG), ("http", _LINK), ("[", _CLOCK)):
        if mark in text:
            text = pattern.sub(" ", text)
    return _ZERO.sub("o", _BULLET.sub("\n", "\n" + text)).lower()


class Words:
    """Bucket and length of each word, kept per worker."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows: list[tuple[int, int]] = []

    def look_up(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.limit:
            self.clear()
        for w in set(chain.from_iterable(words)) - self.known.keys():
            self.known[w] = len(self.rows)
            self.rows.append((crc32(w.encode("utf-8", "replace")) % BUCKETS, len(w)))
        counts = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        return np.array(self.rows, np.int64).reshape(-1, 2)[at], counts


_words = Words()


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def measure(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of syntax and of the shape of each text, and the bucket of each of its words with their counts."""
    cleaned = [plain(t) for t in texts]
    words = [_WORD.findall(t) for t in cleaned]
    rows, counts = _words.look_up(words)
    n = np.maximum(counts, 1)
    length = rows[:, 1]
    sizes = np.fromiter(map(len, cleaned), np.int64, len(texts))
    blanks = np.array([sum(map(t.count, " \n\t\r\xa0")) for t in cleaned], np.int64)
    digits = np.array([sum(map(t.count, "0123456789")) for t in cleaned], np.int64)
    stops = np.array([len(_STOP.findall(t)) for t in cleaned], np.int64)
    commas, semis = (np.array([t.count(c) for t in cleaned], np.int64) for c in ",;")
    kinds = np.array([len(set(w)) for w in words], np.int64)
    letters = _sums(length, counts)
    per_sentence = counts / np.maximum(stops, 1)
    dense = np.stack(
        [
            np.log1p(per_sentence),
            letters / n / 5,
            _sums(length >= 7, counts) / n,
            _sums(length >= 10, counts) / n,
            _sums(length >= 13, counts) / n,
            _sums(length <= 3, counts) / n,
            commas / n * 10,
            semis / n * 10,
            np.log1p(commas / np.maximum(stops, 1)),
            np.log1p(counts) / 5,
            kinds / np.sqrt(n) / 10,
            np.sqrt(_sums(length**2, counts) / n) / 5,
            (stops > 0).astype(float),
        ],
        axis=1,
    )
    visible = np.maximum(sizes - blanks, 1)
    lines = np.array([t.count("\n") for t in cleaned], np.int64)
    shape = np.stack(
        [
            letters / visible,
            digits / visible,
            1 - (letters + digits) / visible,
            blanks / np.maximum(sizes, 1),
            np.log1p(counts),
            np.log1p(kinds),
            np.log1p(lines) / np.log1p(counts + 1),
            np.minimum(np.log1p(per_sentence), 6),
            np.minimum(letters / n, 20) / 5,
        ],
        axis=1,
    )
    return dense, shape, rows[:, 0], counts


class Prose:
    """Which texts are mainly running prose, learned from graded ones (which are) and others (of which most are).

    A logistic model tells graded from other texts by their shape and by how
    usual their words are among the graded ones. Those of the others that it
    gives less than ``share`` of the mean chance of graded ones are surely no
    prose; a second model tells graded texts from these, and decides.
    """

    def __init__(self, shape: np.ndarray, bags: np.ndarray, graded: np.ndarray, share: float = 0.05, decay: float = 3.0, folds: int = 5, seed: int = 7):
        usual = bags[graded].mean(0)
        self.words = np.log((usual + 1e-4) / (1 / BUCKETS + 1e-4))
        self.model = None
        if graded.all():
            return
        x = np.concatenate([shape, bags @ self.words[:, None]], 1)
        fold = np.random.default_rng(seed).permutation(len(x)) % folds
        slips = np.zeros(len(x), bool)
        for k in range(folds):
            out = graded & (fold == k)
            if out.any() and (graded & ~out).sum() >= folds:
                self.model = self._fit(x[~out], graded[~out], share, decay)
                slips[out] = ~self._passes(x[out])
        # A graded text that the others say is no prose was graded by a slip.
        graded = graded & ~slips
        self.model = self._fit(x, graded, share, decay)
        scraps = ~graded & ~self._passes(x)
        self.model = self._fit(x[graded | scraps], graded[graded | scraps], None, decay) if scraps.any() else None

    @staticmethod
    def _spread(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
        z = np.clip((x - centre) / scale, -8, 8)
        return np.concatenate([z / 3, z**2 / 3, np.ones((len(z), 1))], 1)

    @classmethod
    def _fit(cls, x: np.ndarray, graded: np.ndarray, share: float | None, decay: float) -> tuple:
        centre, scale = x[graded].mean(0), x[graded].std(0) + 1e-3
        z = cls._spread(x, centre, scale)
        weights = np.zeros(z.shape[1])
        for _ in range(60):
            chance = 1 / (1 + np.exp(-np.clip(z @ weights, -50, 50)))
            bend = (z * (chance * (1 - chance))[:, None]).T @ z + decay * np.eye(len(weights))
            weights = weights + np.linalg.solve(bend, z.T @ (graded - chance) - decay * weights)
        if share is None:
            return centre, scale, weights, 0.0
        least = share * (1 / (1 + np.exp(-np.clip(z[graded] @ weights, -50, 50)))).mean()
        return centre, scale, weights, float(np.log(least / (1 - least)))

    def _passes(self, x: np.ndarray) -> np.ndarray:
        centre, scale, weights, least = self.model
        return self._spread(x, centre, scale) @ weights >= least

    def __call__(self, shape: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.model is None:
            return counts > 0
        usual = _sums(self.words[buckets], counts) / np.maximum(counts, 1)
        return (counts > 0) & self._passes(np.concatenate([shape, usual[:, None]], 1))


def train(dense: np.ndarray, bags: np.ndarray, grades: np.ndarray, rounds: int = 300, pairs: int = 4000, decay: float = 0.02, folds: int = 5, seed: int = 7):
    """Weights of a pairwise ranker and the calibration of its scores.

    One ranker per fold learns from pairs of the other folds; their mean is the
    ranker, and the scores that each fold got from a ranker that had not seen
    it calibrate the levels. ``pairs`` is the number of pairs drawn in each
    fold; a ranker is linear in few features, and more pairs of the same
    bounded sample change it little.
    """
    x = np.concatenate([dense, bags], 1)
    centre, scale = x.mean(0), x.std(0)
    wide = np.concatenate([np.ones(DENSE), np.full(BUCKETS, 0.25)])
    scale = wide / np.maximum(scale, np.concatenate([np.full(DENSE, 1e-3), np.full(BUCKETS, 2e-3)]))
    z = (x - centre) * scale
    rng = np.random.default_rng(seed)
    fold = rng.permutation(len(z)) % folds
    scores, weights = np.zeros(len(z)), []
    for k in range(folds):
        mine = np.flatnonzero(fold != k) if len(z) >= 4 * folds else np.arange(len(z))
        w = np.zeros(z.shape[1])
        momentum = np.zeros_like(w)
        a, b = rng.choice(mine, (2, pairs))
        keep = grades[a] != grades[b]
        a, b = a[keep], b[keep]
        sign, gap = np.sign(grades[a] - grades[b]), np.abs(grades[a] - grades[b])
        if len(a):
            for _ in range(rounds):
                s = z @ w
                pull = sign * gap / (1 + np.exp(np.clip(sign * (s[a] - s[b]), -50, 50))) / gap.sum()
                per_row = np.bincount(a, pull, len(z)) - np.bincount(b, pull, len(z))
                momentum = 0.9 * momentum + per_row @ z - decay * w / len(w) * 10
                w = w + 0.5 * momentum
        weights.append(w)
        at = fold == k
        scores[at] = z[at] @ w
    w = np.mean(weights, 0)
    knots, values = isotonic(scores, grades)
    return w * scale, float(-(centre * scale) @ w), knots, values


def isotonic(scores: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising step function nearest to the grades (pool adjacent violators): block means at their mean scores."""
    blocks: list[list[float]] = []
    for s, g in sorted(zip(scores.tolist(), grades.tolist())):
        blocks.append([g, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def fit(spark: SparkSession, documents: DataFrame, grades: DataFrame, sample: int = 4000):
    """Ranker, calibration and prose model from at most ``sample`` graded and as many other documents, taken by a hash of their ids.

    Several grades of a document are averaged; grades that are null or outside
    1 to 5 are not used. None if nothing is left.
    """
    averaged = grades.where("doc_id IS NOT NULL AND reading_grade BETWEEN 1 AND 5").groupBy("doc_id").agg(F.avg("reading_grade").alias("grade"))
    graded = averaged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    others = documents.where("doc_id IS NOT NULL").select("doc_id").distinct().join(averaged, "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = graded.unionByName(others.withColumn("grade", F.lit(None).cast("double")))
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 x ``sample`` rows of 16 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, "text"):
                dense, shape, buckets, counts = measure(text_list(part.column("text")))
                ends = np.cumsum(counts)
                rows = [
                    {"doc_id": str(i), "grade": g, "dense": [*dense[k].tolist(), *shape[k].tolist()], "buckets": (u := np.unique(buckets[ends[k] - counts[k] : ends[k]], return_counts=True))[0].tolist(), "counts": u[1].tolist()}
                    for k, (i, g) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("grade").to_pylist()))
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("doc_id", pa.string()), ("grade", pa.float64()), ("dense", pa.list_(pa.float64())), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
    got = texts.mapInArrow(run, "doc_id string, grade double, dense array<double>, buckets array<int>, counts array<int>").toArrow().sort_by("doc_id").to_pylist()
    known = np.array([r["grade"] is not None and len(r["buckets"]) > 0 for r in got], bool)
    if known.sum() < 10 or len({r["grade"] for r, k in zip(got, known) if k}) < 2:
        return None
    bags = np.zeros((len(got), BUCKETS), np.float32)
    for row, r in zip(bags, got):
        row[r["buckets"]] = np.array(r["counts"]) / max(sum(r["counts"]), 1)
    dense = np.array([r["dense"] for r in got])
    prose = Prose(dense[:, DENSE:], bags, known)
    return *train(dense[known, :DENSE], bags[known], np.array([r["grade"] for r, k in zip(got, known) if k])), prose


def levels(spark: SparkSession, documents: DataFrame, grades: DataFrame, sample: int = 4000) -> DataFrame:
    """Reading level of every document: ``doc_id``, ``score``, ``expected_grade`` and ``level`` (1 to 5).

    All three are null for documents that are not mainly running prose: blank
    and null texts, and those unlike the graded ones (records, tables, logs,
    scraps). A whole text counts, of whatever length. Without usable grades no
    document has a level; where every document is graded all are prose.
    """
    model = fit(spark, documents, grades, sample)
    source = documents.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    if model is None:
        return source.selectExpr("doc_id", "CAST(NULL AS double) AS score", "CAST(NULL AS double) AS expected_grade", "CAST(NULL AS int) AS level")
    weights, offset, knots, values, prose = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, "text"):
                dense, shape, buckets, counts = measure(text_list(part.column("text")))
                score = dense @ weights[:DENSE] + _sums(weights[DENSE:][buckets], counts) / np.maximum(counts, 1) + offset
                grade = np.interp(score, knots, values)
                level = np.clip(np.floor(grade + 0.5), 1, LEVELS).astype(np.int32)
                no = ~prose(shape, buckets, counts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, mask=no), pa.array(grade, mask=no), pa.array(level, mask=no)], names=["doc_id", "score", "expected_grade", "level"])

    return source.mapInArrow(run, f"doc_id {kind}, score double, expected_grade double, level int")
