"""Language identification by rank-order profiles of character n-grams (out-of-place distance)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_fold
from .tokens import arrow_bytes

_BOUND = 1  # what stands between letters
_CODES: np.ndarray | None = None


def _codes() -> np.ndarray:
    """For each BMP code point: its lower-case letter's code, or 1 where it is no letter."""
    global _CODES
    if _CODES is None:
        _CODES = np.array([ord(c.lower()[0]) if (c := chr(p)).isalpha() else _BOUND for p in range(1 << 16)], dtype=np.uint32)
    return _CODES


def _letters(raw: bytes) -> np.ndarray:
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32)
    out = _codes()[np.minimum(points, 0xFFFF)]
    for p in np.unique(points[points > 0xFFFF]):  # rare scripts share 6,400 private codes
        out[points == p] = 0xE000 + p % 6400 if chr(p).isalpha() else _BOUND
    return out


def gram_counts(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count) of the 1- to 3-grams in words of each text, a word's ends being one boundary; sorted by text and n-gram."""
    n = sum(map(len, parts))
    seq, doc, at = np.full(n + len(parts) + 1, _BOUND, np.uint64), np.zeros(n + len(parts) + 1, np.uint64), 1
    for i, p in enumerate(parts):
        seq[at : at + len(p)], doc[at : at + len(p)] = p, i
        at += len(p) + 1
    keep = seq != _BOUND
    keep[1:] |= seq[:-1] != _BOUND
    keep[0] = True
    seq, doc = seq[keep], doc[keep] << np.uint64(48)
    letter = seq != _BOUND
    pair = (seq[:-1] << np.uint64(16)) | seq[1:]
    some = letter[:-1] | letter[1:]
    key = [
        (doc | seq)[letter],
        (np.where(letter[:-1], doc[:-1], doc[1:]) | pair)[some],
        (doc[1:-1] | (pair[:-1] << np.uint64(16)) | seq[2:])[letter[1:-1]] if len(seq) > 2 else seq[:0],
    ]
    key = np.concatenate(key)
    key.sort()
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(48)).astype(np.int64), (key & np.uint64((1 << 48) - 1)).astype(np.int64), count


def _runs(col: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[np.ndarray]]]:
    buf, offsets = arrow_bytes(col)
    first, parts, size = 0, [], 0
    for i in range(len(offsets) - 1):
        parts.append(_letters(buf[offsets[i] : offsets[i + 1]].tobytes()))
        size += len(parts[-1])
        if size >= most or len(parts) >= 4000:
            yield first, parts
            first, parts, size = i + 1, [], 0
    if parts:
        yield first, parts


def profiles(labelled: DataFrame, top: int = 300) -> dict[str, list[int]]:
    """For each language its ``top`` most frequent n-grams, best first (ties: smaller code). ``labelled``: text, lang."""

    def count(batches):
        for b in batches:
            langs = b.column("lang").to_pylist()
            names = sorted(set(langs))
            for first, parts in _runs(b.column("text")):
                for name in names:
                    if own := [p for i, p in enumerate(parts) if langs[first + i] == name]:
                        _, gram, n = gram_counts([np.concatenate([x for p in own for x in (p, np.array([_BOUND], np.uint32))])])
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    grams = labelled.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = grams.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= top).orderBy("lang", "r").collect()  # top rows a language
    out: dict[str, list[int]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Ranker:
    """Out-of-place distances of texts to known profiles."""

    def __init__(self, known: dict[str, list[int]], top: int = 300):
        self.names, self.top = sorted(known), top
        self.union = np.array(sorted({g for p in known.values() for g in p}), dtype=np.int64)
        self.ranks = np.full((len(self.union) + 1, max(1, len(self.names))), top, dtype=np.int64)
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.union, np.array(known[name], np.int64)), j] = np.arange(len(known[name]))

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text the index of its language (the number of languages: undetermined) and its score."""
        label, value = np.full(len(col), len(self.names)), np.zeros(len(col))
        for first, parts in _runs(col):
            doc, gram, count = gram_counts(parts)
            if not len(doc) or not self.names:
                continue
            order = np.argsort((doc << 32) - count, kind="stable")
            doc, gram = doc[order], gram[order]
            begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            rank = np.arange(len(doc)) - np.repeat(begins, np.diff(np.append(begins, len(doc))))
            keep = rank < self.top
            doc, gram, rank = doc[keep], gram[keep], rank[keep]
            at = np.searchsorted(self.union, gram)
            at[self.union[np.minimum(at, len(self.union) - 1)] != gram] = len(self.union)
            known = self.ranks[at]
            apart = np.where(known == self.top, self.top, np.abs(known - rank[:, None]))
            begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            total = np.add.reduceat(apart, begins, axis=0)
            size = np.diff(np.append(begins, len(doc)))
            best = total.argmin(axis=1)
            label[first + doc[begins]] = best
            value[first + doc[begins]] = 1 - total[np.arange(len(best)), best] / (self.top * size)
        return label, value


def classify(docs: DataFrame, known: dict[str, list[int]], top: int = 300) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``; whole texts are read.

    A document's ``top`` most frequent n-grams are ranked (ties: smaller code); each one's distance to a language is the
    difference of its two ranks, or ``top`` where the profile lacks it. The least sum wins (ties: first name). The score is
    1 - sum / (top * ranked n-grams). Null or letterless text, or no profile at all: ``und``, score 0. Null ids and repeated
    rows are scored like any other; an empty table gives no rows; other columns are not looked at.
    """
    rank = Ranker(known, top)

    def score(batches):
        for b in batches:
            label, value = rank(b.column("text"))
            pred = pa.array([*rank.names, "und"], pa.string()).take(pa.array(label))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pred, pa.array(value)], ["doc_id", "lang_pred", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(score, "doc_id long, lang_pred string, score double")


def learn(docs: DataFrame, each: int = 2000, top: int = 300, languages: int = 1000) -> dict[str, list[int]]:
    """Profiles from some ``each`` documents of a language (all, if there are fewer); never from the held-out fold. At most the
    ``languages`` values of lang with the most documents are learnt (ties: first name).

    A language's documents are drawn by a hash of the id against ``each`` over their count, so the draw needs no sort and is
    the same however the rows lie. The bound is on what the profiles are fitted on. Rows of null lang, null id or null text
    teach nothing.
    """
    own = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"))
    counts = docs.select("doc_id", "lang").filter(own).groupBy("lang").agg(F.count("*").alias("of")).orderBy(F.desc("of"), "lang").limit(languages)
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 30)) * F.col("of") < F.lit(each << 30)
    rows = docs.select("doc_id", "lang", "text").filter(own & F.col("text").isNotNull())
    return profiles(rows.join(F.broadcast(counts), "lang").filter(drawn), top)  # counts: one row a language


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = classify(docs, learn(docs))
    return out.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def stage_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language can't be told: ``und``, that is null or letterless text. All others stay as they are."""
    rank = Ranker(learn(docs))

    def keep(batches):  # whole rows pass through: no join by an id that may repeat or be null
        for b in batches:
            yield b.filter(pa.array(rank(b.column("text"))[0] < len(rank.names)))

    return docs.mapInArrow(keep, docs.schema)
