"""N-gram Jaccard join by PartEnum signatures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, buckets_for, discard, free_shuffles, join_ids, materialize, ship, small_batches
from .neardup import NO_ID, ROWS_DDL, exchange, linked_components, node_hash, node_rows, packed, to_rows
from .tokens import NOT_SPACE, Words, chunks, mix, shingle_sets, trim

U = np.uint64
SEEDS = 6
#: Signatures that a map task packs at a time.
MOST_SIGNATURES = 1 << 19


class PartEnum:
    """Signatures such that any two sets of Jaccard ``per_cent`` / 100 or more share one.

    Sets fall into bands by the larger set's size; a set also takes part in the bands above its own in which it could be the
    smaller one. In a band of sizes up to M, linked sets differ in at most k = 2M(100 - t) / (100 + t) elements. The domain is
    cut into n1 partitions of three parts each, and every subset of two of the three is a signature: a hash of all elements the
    set has in it. (Where k is 1, one partition is enough: two parts of one partition hold no difference. Where k is 0, linked
    sets are equal; equal sets are one node and need no signature.) A partition with no difference gives three equal subsets, one
    with one difference gives one, so at least 2 n1 - k subsets (3 n1 - 2 k, if k < n1) are equal in linked sets.

    An empty subset says nothing and is left out; both sets of a pair leave out the same ones. A set with fewer empty subsets
    than are sure to be equal so shares another one with every set it is linked to. Others, few by the choice of n1, are signed
    again with another cut of the domain, up to ``SEEDS`` times, and sets for which that never helps share one signature a band.
    """

    def __init__(self, per_cent: int, ratio: float = 1.35):
        self.t = per_cent
        low, lows = 1, []
        while low < 1 << 40:
            lows.append(low)
            low = max(low + 1, int(low * ratio))
        self.lows = np.array(lows, dtype=np.int64)
        most = self.lows[1:] - 1
        self.k = 2 * most * (100 - per_cent) // (100 + per_cent)
        least = np.maximum(1, self.lows[:-1] * per_cent // 100)  # of the sets that take part
        self.parts = np.array([self._partitions(int(k), int(n)) for k, n in zip(self.k, least, strict=True)], np.int64)
        self.sure = np.where(self.k < self.parts, 3 * self.parts - 2 * self.k, 2 * self.parts - self.k)

    @staticmethod
    def _partitions(k: int, least: int) -> int:
        """So many that the smallest set is seldom left with too many empty subsets; twice what is needed at most."""
        need = max(1, k // 2 + 1)
        n1 = need
        while n1 < 2 * need:
            empty = 3 * n1 * np.exp(-2 * least / (3 * n1))
            if empty + 2 * np.sqrt(3 * empty) < (3 * n1 - 2 * k if k < n1 else 2 * n1 - k):
                break
            n1 += max(1, n1 // 64)
        return n1

    def bands(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sets of sizes n: (index of the set, band) of all bands it takes part in where sets can differ."""
        first = np.searchsorted(self.lows, n, side="right") - 1
        last = np.searchsorted(self.lows * self.t, n * 100, side="right") - 1  # the set can be the smaller one of the pair
        count = np.where(n > 0, np.maximum(last, first) - first + 1, 0)
        which = np.repeat(np.arange(len(n)), count)
        band = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        good = self.k[np.minimum(band, len(self.k) - 1)] > 0
        return which[good], band[good]

    def sign(self, doc: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(set, signature) of sets given as (set, element hash), sorted by set."""
        size = np.bincount(doc, minlength=docs)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        which, band = self.bands(size)
        out_set, out_sig = [], []
        for seed in range(SEEDS):
            if not len(which):
                break
            n1 = self.parts[band]
            base = np.concatenate([[0], np.cumsum(3 * n1)])
            count = size[which]
            owner = np.repeat(np.arange(len(which)), count)
            at = np.repeat(begin[which] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            x = mix(h[at] + U(seed * 0x9E3779B1 + 1))
            flat = base[owner] + (((x >> U(32)) * (3 * n1[owner]).astype(np.uint64)) >> U(32)).astype(np.int64)
            total = base[-1]
            filled = np.bincount(flat, minlength=total)
            order = np.argsort(flat, kind="stable")
            with np.errstate(over="ignore"):
                sums = np.zeros(len(x) + 1, np.uint64)
                np.cumsum(mix(x)[order], out=sums[1:])
                end = np.cumsum(filled)
                part = sums[end] - sums[end - filled]
                member = np.repeat(np.arange(len(which)), 3 * n1)
                number = np.arange(total) - base[member]
                part = mix(part + mix((band[member].astype(np.uint64) << U(40)) + (number.astype(np.uint64) << U(3)) + U(seed)))
                empty = np.zeros(len(which), np.int64)
                for i, j in ((0, 1), (0, 2), (1, 2)):
                    some = filled[i::3] + filled[j::3] > 0
                    of = member[::3]
                    out_set.append(which[of[some]])
                    out_sig.append(mix(part[i::3][some] * U(3) + part[j::3][some]))
                    empty += np.bincount(of[~some], minlength=len(which))
            bad = empty >= self.sure[band]
            which, band = which[bad], band[bad]
        out_set.append(which)
        out_sig.append(mix((band.astype(np.uint64) << U(40)) + U(0xFFFF)))
        return np.concatenate(out_set), np.concatenate(out_sig)


def jaccard_components(docs: DataFrame, k: int = 4, per_cent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    A-Z are lower-cased; words are runs of anything but ASCII white space; a document's set holds its distinct k-word shingles,
    or its whole word sequence if it has fewer words. Documents of Jaccard ``per_cent`` / 100 or more are linked; component_id
    is the least doc_id reachable by links. Whole texts are read; shingles are compared by 64-bit hashes.

    Null, empty or wordless text: an empty set, linked with nothing. Null doc_id: its row has a null component and links nothing.
    Repeated rows each get a row. Empty table: no rows. Other columns are not looked at. Copies are one node, so their number
    adds nothing but their own rows.
    """
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    buckets = buckets_for(own, 4 << 20)
    scheme = PartEnum(per_cent)

    def sign(batches):
        for b in batches:
            ids = b.column("doc_id").fill_null(NO_ID).to_numpy()
            sigs, nodes, counts, rows, held = [], [], [], [], 0
            seen = np.zeros(0, np.int64)
            for first, last, buf, offs in chunks(b.column("text")):
                doc, h = shingle_sets(Words(buf, offs, NOT_SPACE), k)
                n = last - first
                node = node_hash(doc, h, n)
                counts.append(np.stack([ids[first:last], np.bincount(doc, minlength=n), node]))
                # a set is signed once in a batch
                _, lead = np.unique(node, return_index=True)
                new = np.zeros(n, bool)
                new[lead] = True
                new &= (node != 0) & (ids[first:last] != NO_ID) & ~np.isin(node, seen)
                keep = new[doc]
                which, sig = scheme.sign(doc[keep], h[keep], n)
                rows += node_rows(node, doc, h, new, buckets)
                sigs.append(sig)
                nodes.append(node[which])
                seen = np.union1d(seen, node[new])
                held += len(sig)
                if held >= MOST_SIGNATURES:
                    yield to_rows([*rows, *packed(np.concatenate(sigs), np.concatenate(nodes), buckets)])
                    sigs, nodes, rows, held = [], [], [], 0
                    trim()
            if counts:
                done = np.concatenate(counts, axis=1)
                rows.append((int(abs(int(done[0, 0])) % buckets), 2, done.astype(np.int64).tobytes()))
                yield to_rows([*rows, *(packed(np.concatenate(sigs), np.concatenate(nodes), buckets) if sigs else ())])

    met = exchange(own.mapInArrow(sign, ROWS_DDL), "pe-met")
    found = met.filter("tag = 2").select(F.when(F.col("x") != NO_ID, F.col("x")).alias("doc_id"), F.col("y").alias("n_shingles"), F.col("z").alias("node"))
    sets = met.filter("tag = 1").select(F.col("x").alias("sid"), "data")
    bits = materialize(met.filter("tag = 5").groupBy(F.col("x").alias("node")).agg(F.first("y").alias("n"), F.first("data").alias("bits")), "pe-bits")
    found = materialize(found, "pe-found")

    def texts(nodes: DataFrame) -> DataFrame:
        reps = join_ids(found.filter("doc_id is not null"), nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
        return join_ids(own, materialize(reps, "pe-reps"), "doc_id", "inner").select("node", "text")

    labels = linked_components(sets, bits, texts, NOT_SPACE, k, per_cent)
    discard(met, bits)
    out = _with_components(found, labels)
    discard(labels)
    return out


def _with_components(found: DataFrame, labels: DataFrame) -> DataFrame:
    alone = found.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    full = found.filter("n_shingles > 0 and doc_id is not null").join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("comp", "node").alias("comp"))
    full, none = materialize(full, "pe-labelled"), materialize(alone, "pe-alone")
    discard(found)
    least = materialize(full.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "pe-least")
    return full.join(least, "comp").select("doc_id", "n_shingles", "component_id").unionByName(none)


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, per_cent=85)


def stage_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of least id; five-word shingles, Jaccard 0.8 or more. Rows without an id stay.

    Rows go by doc_id alone: if two share an id and one text is a copy of an earlier document's, both go; repeated rows of an id that stays all stay.
    """
    name = "gone" + "_" * max([0, *(len(c) for c in docs.columns)])
    gone = jaccard_components(docs, k=5, per_cent=80).filter("component_id < doc_id").select(F.col("doc_id").alias(name)).distinct()
    gone = materialize(gone, "pe-gone")
    free_shuffles(spark)
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].cast("long") == F.col(name), "left_anti")
