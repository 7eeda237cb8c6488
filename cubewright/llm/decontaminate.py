"""Benchmark decontamination by an FM-index of each training shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import ALNUM, Words, chunks

#: Symbols of an index; a shard of more is indexed in several (a single longer document has an index of its own).
INDEX_SYMBOLS = 1_000_000
#: UTF-8 bytes of benchmark text that go to all tasks at once; a larger benchmark is searched block by block.
BLOCK_BYTES = 8 << 20


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of symbols where 0 separates; separators differ from each other and sort by place. Prefix doubling, ties only."""
    n = len(text)
    zero = text == 0
    seps = int(zero.sum())
    rank = np.where(zero, np.cumsum(zero) - 1, text.astype(np.int64) + seps)
    order = np.argsort(rank, kind="stable")
    ranked = rank[order]
    starts = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    group = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    rank[order] = group
    k = 1
    tied = np.flatnonzero(~starts | np.concatenate([~starts[1:], [False]]))  # places in the order that share a rank
    while len(tied):
        at = order[tied]
        key = rank[at] * np.int64(n + 1) + np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[tied] = at = at[by]
        key = key[by]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = tied[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))]
        tied = tied[~first | np.concatenate([~first[1:], [False]])]
        k *= 2
    return order


class FmIndex:
    """Counts and places of word phrases: BWT in a wavelet matrix, positions sampled every ``rate`` and at run starts."""

    def __init__(self, text: np.ndarray, symbols: int, rate: int = 8):
        sa = suffix_array(text)
        self.n = len(text)
        self.bwt = text[sa - 1]  # the text ends with a separator, so place 0 is preceded by one
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        sampled = (sa % rate == 0) | (self.bwt == 0)
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = sa[sampled]
        self.sampled = sampled
        self.levels: list[tuple[int, np.ndarray, int]] = []
        seq = self.bwt
        for bit in range(max(1, int(symbols).bit_length()) - 1, -1, -1):
            ones = (seq >> bit) & 1
            before = np.zeros(self.n + 1, dtype=np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, before, self.n - int(before[-1])))
            mask = ones.astype(bool)
            seq = np.concatenate([seq[~mask], seq[mask]])
        every = np.arange(symbols + 1)
        self.base = self._down(every, np.zeros(symbols + 1, dtype=np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, before, zeros in self.levels:
            ones = before[i]
            i = np.where((c >> bit) & 1, zeros + ones, i - ones)
        return i

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """C[c] + rank of c before row i."""
        return self.less[c] + self._down(c, i) - self.base[c]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place) of every occurrence of every row of ``phrases`` (symbols from 1)."""
        alive = np.arange(len(phrases))
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, j]
            lo, hi = self.step(c, lo), self.step(c, hi)
            some = lo < hi
            alive, lo, hi = alive[some], lo[some], hi[some]
            if not len(alive):
                break
        size = hi - lo
        rows = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.repeat(alive, size), self.locate(rows)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps, going = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(going := going[~self.sampled[rows[going]]]):
            r = rows[going]
            rows[going] = self.step(self.bwt[r], r)
            steps[going] += 1
        return self.samples[self.sample_rank[rows]] + steps


class Phrases:
    """The windows of benchmark items, as symbols of the items' own vocabulary."""

    def __init__(self, items: list[tuple[object, str | None]], length: int = 13):
        raw = pa.array([t for _, t in items], pa.string())
        self.names = [None if i is None else str(i) for i, _ in items]
        hashes: list[np.ndarray] = []
        for _, _, buf, offs in chunks(raw):
            w = Words(buf, offs, ALNUM)
            hashes += [w.hash[w.first[k] : w.first[k + 1]] for k in range(len(w.counts))]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        by_length: dict[int, list] = {}
        for i, h in enumerate(hashes):
            ids = np.searchsorted(self.vocabulary, h) + 1
            k = min(length, len(ids))
            if k:
                by_length.setdefault(k, []).append((np.lib.stride_tricks.sliding_window_view(ids, k), i))
        self.groups = []
        for k, own in sorted(by_length.items()):
            windows = np.concatenate([x for x, _ in own])
            owner = np.concatenate([np.full(len(x), i) for x, i in own])
            distinct, back = np.unique(windows, axis=0, return_inverse=True)
            order = np.argsort(back.ravel(), kind="stable")
            starts = np.searchsorted(back.ravel()[order], np.arange(len(distinct) + 1))
            self.groups.append((distinct, owner[order], starts))
        self.shortest = min(by_length, default=0)


class _Shard:
    """Gathers the runs of vocabulary words of a shard's documents and finds the phrases in them."""

    def __init__(self, phrases: Phrases):
        self.p = phrases
        self.clear()

    def clear(self) -> None:
        self.symbols, self.docs, self.words, self.size = [], [], [], 0

    def add(self, doc: np.ndarray, word: np.ndarray, symbol: np.ndarray) -> None:
        """Words of whole documents. Only runs of benchmark words that are as long as the shortest phrase can hold one."""
        if not len(symbol) or not self.p.shortest:
            return
        known = symbol > 0
        breaks = np.ones(len(symbol), dtype=bool)
        breaks[1:] = (doc[1:] != doc[:-1]) | (known[1:] != known[:-1])
        begin = np.flatnonzero(breaks)
        length = np.diff(np.append(begin, len(symbol)))
        good = known[begin] & (length >= self.p.shortest)
        if not good.any():
            return
        begin, length = begin[good], length[good]
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(length + 1)[:-1]]), length + 1) + np.arange((length + 1).sum())
        ends = np.cumsum(length + 1) - 1
        at[ends] = 0
        out = symbol[at]
        out[ends] = 0
        self.symbols.append(out)
        self.docs.append(doc[at])
        self.words.append(word[at])
        self.size += len(out)

    def find(self) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """(document, word) of every hit word in order, and the (document, item) pairs of occurrences."""
        if not self.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), []
        text, doc, word = (np.concatenate(x) for x in (self.symbols, self.docs, self.words))
        self.clear()
        index = FmIndex(text, len(self.p.vocabulary))
        cover = np.zeros(len(text) + 1, np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        for windows, owner, starts in self.p.groups:
            which, place = index.search(windows)
            if not len(which):
                continue
            np.add.at(cover, place, 1)
            np.add.at(cover, place + windows.shape[1], -1)
            found = np.unique(np.stack([doc[place], which], 1), axis=0)
            size = starts[found[:, 1] + 1] - starts[found[:, 1]]
            at = np.repeat(starts[found[:, 1]] - np.cumsum(size) + size, size) + np.arange(size.sum())
            pairs.append(np.stack([np.repeat(found[:, 0], size), owner[at]], 1))
        hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        return doc[hit], word[hit], [tuple(x) for x in np.unique(np.concatenate(pairs), axis=0).tolist()]


STATE = ("hit_words", "hit_spans", "hit_items", "word_count")
_STATE_TYPES = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64())
_STATE_DDL = ("array<bigint>", "array<bigint>", "array<string>", "bigint")


def _runs(words: np.ndarray) -> np.ndarray:
    """[first, last + 1, first, last + 1, ...] of consecutive numbers."""
    if not len(words):
        return words
    cut = np.flatnonzero(np.diff(words) > 1) + 1
    return np.stack([words[np.concatenate([[0], cut])], words[np.concatenate([cut - 1, [len(words) - 1]])] + 1], 1).ravel()


def _search(batches, phrases, out: list[str], names: list[str]):
    """Bring the state columns of each batch up to date with one block of phrases."""
    p: Phrases = phrases.value
    for b in batches:
        n = b.num_rows
        col = b.column("text")
        counts = np.zeros(n, np.int64)
        hits: dict[int, list[np.ndarray]] = {}
        items: dict[int, set] = {}
        shard = _Shard(p)

        def flush(shard=shard, hits=hits, items=items):
            doc, word, pairs = shard.find()
            for d in np.unique(doc):
                hits.setdefault(int(d), []).append(word[doc == d] if len(doc) < 5000 else word[np.searchsorted(doc, d, "left") : np.searchsorted(doc, d, "right")])
            for d, i in pairs:
                items.setdefault(d, set()).add(i)

        for first, last, buf, offs in chunks(col):
            w = Words(buf, offs, ALNUM)
            counts[first:last] = w.counts
            symbol = np.searchsorted(p.vocabulary, w.hash) if len(p.vocabulary) else np.zeros(len(w.hash), np.int64)
            if len(p.vocabulary):
                symbol = np.where(p.vocabulary[np.minimum(symbol, len(p.vocabulary) - 1)] == w.hash, symbol + 1, 0)
            doc = w.doc()
            shard.add(doc + first, np.arange(len(doc)) - w.first[:-1][doc], symbol)
            if shard.size >= INDEX_SYMBOLS:
                flush()
        flush()
        old = {c: b.column(c).to_pylist() if c in b.schema.names else [None] * n for c in names[:3]}
        words, spans, found = [[]] * n, [[]] * n, [[]] * n
        for d in range(n):
            mine = hits.get(d)
            if mine is None and not old[names[0]][d]:
                continue
            flat = old[names[0]][d] or []
            whole = np.unique(np.concatenate([np.zeros(0, np.int64), *(mine or []), *[np.arange(x, y) for x, y in zip(flat[::2], flat[1::2], strict=True)]]))
            words[d] = _runs(whole).tolist()
            own = Words(*_one(col, d), ALNUM)
            r = np.array(words[d])
            spans[d] = np.stack([own.starts[r[::2]], own.ends[r[1::2] - 1]], 1).ravel().tolist()
            found[d] = sorted({*(old[names[2]][d] or []), *(x for i in items.get(d, ()) if (x := p.names[i]) is not None)})
        state = dict(zip(names, [pa.array(words, _STATE_TYPES[0]), pa.array(spans, _STATE_TYPES[1]), pa.array(found, _STATE_TYPES[2]), pa.array(counts)], strict=True))
        yield pa.RecordBatch.from_arrays([state[c] if c in state else b.column(c) for c in out], out)


def _one(col: pa.Array, d: int):
    return next(iter(chunks(col.slice(d, 1))))[2:]


def mark(docs: DataFrame, benchmark: DataFrame, keep: list[str], length: int = 13, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[str]]:
    """Add to every row of ``docs`` (with the columns ``keep``) what of ``benchmark`` (item_id, text) occurs in it.

    A-Z are lower-cased and words are runs of ASCII letters, digits and non-ASCII characters. A phrase is each ``length``
    consecutive words of an item, or all words of a shorter one. Each shard of documents (an Arrow batch, by
    ``INDEX_SYMBOLS``) gets an FM-index over its runs of benchmark words: a run that is shorter than the shortest phrase can
    hold none and is left out; no other word can be part of a phrase. Words are compared by 64-bit hashes.

    The benchmark goes to the tasks in blocks of at most ``block_bytes`` of text; a larger one takes several passes in one
    stage, and the hits of all blocks are united. Returns the DataFrame and the names of its state columns: ranges of hit
    words [from, to, ...], the same in UTF-8 bytes, the ids of occurring items as sorted strings, and the number of words.

    Null text has no words. An item of null text has no phrase; one of null id marks words but is not listed. Rows that share
    an item_id are one item. Empty tables: no rows, or no hits. Ids of documents are not looked at.
    """
    spark = docs.sparkSession
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    names = [f"{s}{'_' * max([0, *(len(c) for c in docs.columns if c.startswith(s))])}" for s in STATE]
    state = ", ".join(f"{c} {t}" for c, t in zip(names, _STATE_DDL, strict=True))
    at = docs
    for k in range(blocks):
        part = benchmark if blocks == 1 else benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        phrases = spark.sparkContext.broadcast(Phrases([(r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()], length))
        own = list(dict.fromkeys(keep if k == blocks - 1 else [*keep, "text"]))
        types = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own), state])
        at = at.mapInArrow(lambda it, phrases=phrases, out=[*own, *names]: _search(it, phrases, out, names), types)
    return at, names


def hit_words(words: str) -> Column:
    """How many words the ranges [from, to, ...] hold."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2, F.lit(2)), lambda i: F.get(words, i + 1) - F.get(words, i))
    return F.when(F.size(words) > 0, F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))


def report(docs: DataFrame, benchmark: DataFrame, length: int = 13, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (a 1 / ``share`` of all words or more is hit), items, spans."""
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    at, (words, spans, items, count) = mark(own, benchmark, ["doc_id"], length)
    hit = hit_words(words)
    return at.select("doc_id", F.col(count).alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), F.col(items).alias("items"), F.col(spans).alias("spans")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def stage_decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents; all others, lightly hit ones too, stay as they are."""
    at, (words, _, _, count) = mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), docs.columns)
    hit = hit_words(words)
    return at.filter(~((hit > 0) & (hit * 20 >= F.col(count)))).select(*docs.columns)
