"""Quality classifier: a generalised additive model with pairwise interactions, boosted cyclically from shallow trees."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold
from .tokens import ALNUM, NOT_SPACE, Words, chunks

#: Byte classes: 0 lower-case letter, 1 upper-case letter, 2 digit, 3 space or tab, 4 line end, 5 sentence mark, 6 other sign, 7 non-ASCII.
_CLASS = np.full(256, 6, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9]], _CLASS[[10, 13]], _CLASS[128:] = 0, 1, 2, 3, 4, 7
_CLASS[[ord(c) for c in ".,;:'\"?-()"]] = 5
_LINE = np.ones(256, dtype=bool)
_LINE[10] = False
FEATURES = ("bytes", "upper", "digits", "spaces", "line_ends", "marks", "signs", "non_ascii", "words", "word_length", "distinct_words", "repeats", "distinct_lines", "line_words")


def _distinct(w: Words) -> np.ndarray:
    key = (w.doc().astype(np.uint64) << np.uint64(54)) | (w.hash >> np.uint64(10))
    key.sort()
    return np.bincount((key[np.concatenate([[True], key[1:] != key[:-1]])] >> np.uint64(54)).astype(np.int64), minlength=len(w.counts)) if len(key) else np.zeros(len(w.counts))


def features(col: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text, from all its bytes, words and lines; null counts as empty."""
    out = np.zeros((len(col), len(FEATURES)))
    for a, b, buf, offs in chunks(col):
        n = b - a
        doc = np.repeat(np.arange(n), np.diff(offs))
        kinds = np.bincount(doc * 8 + _CLASS[buf], minlength=8 * n).reshape(n, 8).astype(float)
        size = np.diff(offs).astype(float)
        one = np.maximum(size, 1)
        w, lines, pieces = Words(buf, offs, ALNUM), Words(buf, offs, _LINE), Words(buf, offs, NOT_SPACE)
        words = w.counts.astype(float)
        same = np.zeros(n)
        if len(pieces.hash) > 1:
            again = pieces.hash[1:] == pieces.hash[:-1]
            same = np.bincount(pieces.doc()[1:][again], minlength=n).astype(float)
        at = out[a:b]
        at[:, 0] = np.log1p(size)
        at[:, 1] = kinds[:, 1] / np.maximum(kinds[:, 0] + kinds[:, 1], 1)
        at[:, 2:8] = kinds[:, 2:8] / one[:, None]
        at[:, 8] = np.log1p(words)
        at[:, 9] = (kinds[:, 0] + kinds[:, 1] + kinds[:, 2] + kinds[:, 7]) / np.maximum(words, 1)
        at[:, 10] = _distinct(w) / np.maximum(words, 1)
        at[:, 11] = same / np.maximum(pieces.counts, 1)
        at[:, 12] = _distinct(lines) / np.maximum(lines.counts, 1)
        at[:, 13] = np.log1p(words / np.maximum(lines.counts, 1))
    return out


def _tree(g: np.ndarray, h: np.ndarray, depth: int, smooth: float) -> np.ndarray:
    """Newton steps for each bin of a tree of at most 2**depth leaves over ordered bins with gradient and hessian sums."""
    value = np.full(len(g), g.sum() / (h.sum() + smooth))
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = gl**2 / (hl + smooth) + (g.sum() - gl) ** 2 / (h.sum() - hl + smooth)
        k = int(gain.argmax()) + 1
        if gain[k - 1] > g.sum() ** 2 / (h.sum() + smooth) + 1e-9:
            value = np.concatenate([_tree(g[:k], h[:k], depth - 1, smooth), _tree(g[k:], h[k:], depth - 1, smooth)])
    return value


def _tree2(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[np.ndarray, float]:
    """The same for a grid: one cut of one axis, then one of the other in each half. Also the gain."""
    best, found = -1.0, None
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for k in range(1, gg.shape[0]):
            halves, gain = [], 0.0
            for part in (slice(None, k), slice(k, None)):
                gs, hs = gg[part].sum(0), hh[part].sum(0)
                v = _tree(gs, hs, 1, smooth)
                gain += float((v * gs).sum())
                halves.append(np.repeat(v[None], len(range(*part.indices(gg.shape[0]))), 0))
            if gain > best:
                table = np.concatenate(halves)
                best, found = gain, table.T if turned else table
    return (found if found is not None else np.zeros_like(g)), best


@dataclass
class Gam:
    """Lookup tables: one for each feature, one for each chosen pair; a score is the sigmoid of their sum."""

    bins: int = 32
    coarse: int = 8
    rounds: int = 120
    pairs: int = 5
    rate: float = 0.15
    smooth: float = 2.0
    base: float = 0.0
    edges: list = field(default_factory=list)
    edges2: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pair_tables: dict = field(default_factory=dict)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        cuts = lambda c, k: np.unique(np.quantile(c, np.linspace(0, 1, k + 1)[1:-1])) if len(c) else np.zeros(0)
        self.edges = [cuts(x[:, j], self.bins) for j in range(x.shape[1])]
        self.edges2 = [cuts(x[:, j], self.coarse) for j in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pair_tables = {}
        if not len(y):
            return self
        b = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        b2 = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges2)]
        f = np.full(len(y), self.base)

        def sums(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-f))
            return np.bincount(at, y - p, n), np.bincount(at, p * (1 - p), n)

        for _ in range(self.rounds):
            for j, table in enumerate(self.tables):
                step = self.rate * _tree(*sums(b[j], len(table)), 2, self.smooth)
                table += step
                f += step[b[j]]
        grid = lambda i, j: (b2[i] * (len(self.edges2[j]) + 1) + b2[j], (len(self.edges2[i]) + 1, len(self.edges2[j]) + 1))
        gains = []
        for i in range(len(b)):
            for j in range(i):
                at, shape = grid(i, j)
                g, h = sums(at, shape[0] * shape[1])
                gains.append((_tree2(g.reshape(shape), h.reshape(shape), self.smooth)[1], i, j))
        for _, i, j in sorted(gains, reverse=True)[: self.pairs]:
            self.pair_tables[i, j] = np.zeros(grid(i, j)[1])
        for _ in range(self.rounds // 4):
            for (i, j), table in self.pair_tables.items():
                at, shape = grid(i, j)
                g, h = sums(at, table.size)
                step = self.rate * _tree2(g.reshape(shape), h.reshape(shape), self.smooth)[0]
                table += step
                f += step.ravel()[at]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for j, (e, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            f += table[np.searchsorted(e, x[:, j], side="right")]
        for (i, j), table in self.pair_tables.items():
            f += table[np.searchsorted(self.edges2[i], x[:, i], side="right"), np.searchsorted(self.edges2[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(f, -500, 500)))


def learn(docs: DataFrame, labels: DataFrame, each: int = 10_000) -> Gam:
    """Fit on some ``each`` labelled rows of either class (all, if there are fewer), drawn by a hash of the id; never from the held-out fold.

    Only features reach the driver, of at most 4 * ``each`` rows (a drawn id may be that of many rows). Labels of null id or of another value than 0 and 1 teach nothing.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"))).distinct()
    counts = known.groupBy("quality").agg(F.count("*").alias("of"))  # two rows
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) * F.col("of") < F.lit(each << 30)
    known = known.join(F.broadcast(counts), "quality").filter(drawn).select("doc_id", "quality")

    def rows(batches):
        for b in batches:
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")  # known: some 2 * each rows
    got = own.mapInArrow(rows, "doc_id long, quality int, x array<double>").limit(4 * each).toPandas().sort_values(["doc_id", "quality"], kind="stable")
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return Gam().fit(x, got["quality"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """(doc_id, score) of every row; whole texts are read.

    Null or empty text: all features 0, scored like any other. Null ids and repeated rows are scored too; an empty table gives
    no rows; other columns are not looked at.
    """

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(features(b.column("text"))))], ["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, score double")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
