"""Substring dedup: near-duplicate paragraphs by MinHash banding, and repeated passages inside paragraphs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import buckets_for, discard, free_shuffles, join_ids, materialize, ship, small_batches
from .neardup import ROWS_DDL, exchange, linked_components, node_hash, node_rows, packed, packed_repeats, to_rows
from .tokens import NOT_SPACE, Words, chunks, mix, random_words, run_hashes, shingle_sets, trim, window_hashes

U = np.uint64
#: Bands and rows of the MinHash: two paragraphs of Jaccard 0.8 share a band with probability 1 - (1 - 0.8**3)**14 > 0.9999.
BANDS, ROWS = 14, 3
_FLIP, _TIMES = random_words(BANDS * ROWS, 31), random_words(BANDS * ROWS, 37) | U(1)
#: Runs of words meet in the bucket of their least WINDOW-word window, which neighbouring runs mostly share.
WINDOW = 16
#: Ranges to be removed, some 40 bytes each, that a broadcast may hold; with more, the texts, compressed, are shuffled by their ids.
BROADCAST_RANGES = 50_000
#: Runs of words that a map task compares at a time.
MOST_RUNS = 1 << 18


def band_signatures(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, signature) of all bands for sets given as (document, shingle hash), sorted by document."""
    if not len(doc):
        return doc, h
    begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    sigs = []
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            total = np.full(len(begins), U(band + 1))
            for j in range(band * ROWS, (band + 1) * ROWS):
                total = mix(total + np.minimum.reduceat((h ^ _FLIP[j]) * _TIMES[j], begins))
            sigs.append(total)
    return np.tile(doc[begins], BANDS), np.concatenate(sigs)


def fingerprints(w: Words, first: np.ndarray, length: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, least window in it, index of its first word) of each ``length`` words of a document; ``first``: each document's first word, and the end."""
    h = run_hashes(w.hash, length)
    n = len(h)
    if not n:
        return h, h, np.zeros(0, np.int64)
    least, span = window_hashes(w.hash, min(WINDOW, length)), 1
    among = len(least) - n + 1
    while span < among:
        shift = min(span, among - span)
        least = np.minimum(least[:-shift], least[shift:])
        span += shift
    at = np.flatnonzero(np.arange(n) + length <= np.repeat(first[1:], np.diff(first))[:n])
    return h[at], least[at], at


def _paragraphs(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Offsets of all paragraphs of a run of documents (lines, cut at documents too)."""
    return np.unique(np.concatenate([offs, np.flatnonzero(buf == 10) + 1]))


def find_repeats(docs: DataFrame, min_words: int = 50, k: int = 5, per_cent: int = 80) -> DataFrame:
    """(doc_id, first, last, seen_in, kind) of the word ranges [first, last) to be removed from documents (doc_id, text).

    Words are runs of anything but ASCII white space, A-Z lower-cased. Two kinds of repeats, each kept in the document of least
    id that has it and removed from all other documents; what repeats inside one document alone stays.

    ``paragraph``: lines of at least ``min_words`` words. Lines whose sets of k-word shingles collide in a MinHash band are
    verified by exact Jaccard (``per_cent`` / 100 or more) and clustered by components; a cluster stays in its least document.
    ``passage``: every run of ``min_words`` words or more that stands in an earlier document too, wherever in its lines, from its
    first to its last word; a shorter one never. ``seen_in`` is an earlier document that has all of it, not always the least.

    Null id or null text: nothing is found there. Rows that share an id are one document. Empty table: no rows. Other columns
    are not looked at.
    """
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).filter("doc_id is not null")
    buckets = buckets_for(own)

    def sign(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            rows, sigs, nodes, found, runs, held = [], [], [], [], [], 0
            seen = np.zeros(0, np.int64)
            for start, stop, buf, offs in chunks(b.column("text")):
                lines = _paragraphs(buf, offs)
                if len(lines) < 2:
                    continue
                w = Words(buf, lines, NOT_SPACE)
                first = w.first[np.searchsorted(lines, offs)]
                fp, leader, at = fingerprints(w, first, min_words)
                d = np.searchsorted(first, at, side="right") - 1
                runs.append((fp, leader, ids[start:stop][d], at - first[d]))
                held += len(fp)
                if held >= MOST_RUNS:
                    rows += packed_repeats(*map(np.concatenate, zip(*runs, strict=True)), buckets)
                    yield to_rows(rows)
                    rows, runs, held = [], [], 0
                    trim()
                for i in range(0, len(lines) - 1, 1000):
                    j = min(i + 1000, len(lines) - 1)
                    own_lines = w.part(i, j)
                    line, h = shingle_sets(own_lines, k)
                    long = own_lines.counts >= min_words
                    keep = long[line]
                    line, h = line[keep], h[keep]
                    node = node_hash(line, h, j - i)
                    at_line = np.flatnonzero(long)
                    doc = np.searchsorted(offs, lines[i:j][at_line], side="right") - 1
                    base = w.first[i + at_line] - first[doc]
                    found.append(np.stack([node[at_line], ids[start:stop][doc], (base << 32) | (base + own_lines.counts[at_line])]))
                    _, lead = np.unique(node, return_index=True)
                    new = np.zeros(j - i, bool)
                    new[lead] = True
                    new &= long & ~np.isin(node, seen)
                    keep = new[line]
                    rows += node_rows(node, line, h, new, buckets)
                    which, sig = band_signatures(line[keep], h[keep])
                    sigs.append(sig)
                    nodes.append(node[which])
                    seen = np.union1d(seen, node[new])
            if runs:
                rows += packed_repeats(*map(np.concatenate, zip(*runs, strict=True)), buckets)
            if found:
                rows += packed(np.concatenate(sigs), np.concatenate(nodes), buckets)
                done = np.concatenate(found, axis=1)
                if done.shape[1]:
                    rows.append((int(done[1, 0] % buckets), 2, done.tobytes()))
                yield to_rows(rows)
            trim()

    met = exchange(own.mapInArrow(sign, ROWS_DDL), "ss-met")
    free_shuffles(docs.sparkSession)
    lines = met.filter("tag = 2").select(F.col("x").alias("node"), F.col("y").alias("doc_id"), F.shiftright("z", 32).alias("first"), F.col("z").bitwiseAND((1 << 32) - 1).alias("last"))
    sets = met.filter("tag = 1").select(F.col("x").alias("sid"), "data")
    bits = materialize(met.filter("tag = 5").groupBy(F.col("x").alias("node")).agg(F.first("y").alias("n"), F.first("data").alias("bits")), "ss-bits")

    def texts(nodes: DataFrame) -> DataFrame:
        reps = join_ids(lines, nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "first", "last")).alias("r"))
        reps = materialize(reps.select("node", "r.*"), "ss-reps")
        return join_ids(own, reps, "doc_id", "inner").select("node", "text", "first", "last").mapInArrow(_cut_out, "node long, text string")

    labels = linked_components(sets, bits, texts, NOT_SPACE, k, per_cent)
    discard(bits)
    named = materialize(lines.join(labels, "node", "left").select("doc_id", "first", "last", F.coalesce("comp", "node").alias("comp")), "ss-named")
    discard(labels)
    least = materialize(named.groupBy("comp").agg(F.min("doc_id").alias("seen_in"), F.max("doc_id").alias("most")).filter("seen_in < most").drop("most"), "ss-least")
    by_line = join_ids(named, least, "comp", "inner").filter("doc_id > seen_in").select("doc_id", "first", "last", "seen_in", F.lit("paragraph").alias("kind"))

    def merge(table: pa.Table) -> pa.Table:
        doc, by, at = (table.column(c).to_numpy() for c in ("doc_id", "seen_in", "at"))
        order = np.lexsort((at, by, doc))
        doc, by, first = doc[order], by[order], at[order] >> 32
        last = (at[order] & ((1 << 32) - 1)) + min_words - 1
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (by[1:] != by[:-1])
        group = np.cumsum(new) << 33
        reach = np.maximum.accumulate(group + last) - group  # rows of one id can give the same range twice
        new[1:] |= first[1:] > reach[:-1]
        cut = np.flatnonzero(new)
        return pa.table({"doc_id": doc[cut], "first": first[cut], "last": reach[np.append(cut[1:], len(doc)) - 1], "seen_in": by[cut]})

    places = met.filter("tag = 4").select(F.col("x").alias("doc_id"), F.col("y").alias("at"), F.col("z").alias("seen_in"), F.pmod(F.xxhash64("x"), F.lit(buckets)).alias("bucket"))
    passages = places.groupBy("bucket").applyInArrow(merge, "doc_id long, first long, last long, seen_in long")
    out = materialize(by_line.unionByName(passages.withColumn("kind", F.lit("passage"))), "ss-found")
    discard(met, named, least)
    free_shuffles(docs.sparkSession)
    return out


def _cut_out(batches):
    for b in batches:
        firsts, lasts = b.column("first").to_numpy(), b.column("last").to_numpy()
        out = []
        for start, stop, buf, offs in chunks(b.column("text")):
            w = Words(buf, offs, NOT_SPACE)
            for i in range(stop - start):
                a, z = w.first[i] + firsts[start + i], w.first[i] + lasts[start + i]
                out.append(buf[w.starts[a] : w.ends[z - 1]].tobytes().decode("utf-8", "replace") if z <= w.first[i + 1] else "")
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(out, pa.string())], ["node", "text"])


def _squeezed(batches, text: str):
    """Batches with each text as a Zstandard frame."""
    c = zstandard.ZstdCompressor()
    for b in batches:
        at = b.schema.get_field_index(text)
        frames = [None if t is None else c.compress(t) for t in b.column(at).cast(pa.binary()).to_pylist()]
        yield b.set_column(at, text, pa.array(frames, pa.binary()))


def _plain(col: pa.Array) -> pa.Array:
    """Texts, out of their frames if they are in some."""
    if not pa.types.is_binary(col.type):
        return col
    d = zstandard.ZstdDecompressor()
    return pa.array([None if t is None else d.decompress(t) for t in col.to_pylist()], pa.binary()).cast(pa.string())


def _rewrite(batches, columns: list[str], text: str, ranges: str, stats: bool):
    """Cut the word ranges out of the texts, each with the white space behind it."""
    for b in (batch.slice(i, 1000) for batch in batches for i in range(0, batch.num_rows, 1000)):
        todo = b.column(ranges).to_pylist()
        col = _plain(b.column(text))
        new, words, gone = [], [], []
        for start, stop, buf, offs in chunks(col):
            w = Words(buf, offs, NOT_SPACE)
            for i in range(stop - start):
                own, n = w.starts[w.first[i] : w.first[i + 1]] - offs[i], int(w.counts[i])
                raw = buf[offs[i] : offs[i + 1]]
                mask = np.zeros(n + 1, np.int64)
                for r in todo[start + i] or ():
                    mask[min(r["first"], n)] += 1
                    mask[min(r["last"], n)] -= 1
                cut = np.cumsum(mask[:-1]) > 0
                words.append(n)
                gone.append(int(cut.sum()))
                if not gone[-1]:
                    new.append(col[start + i].as_py())
                    continue
                keep = np.ones(len(raw), bool)
                edges = np.flatnonzero(np.diff(np.concatenate([[False], cut, [False]]).astype(np.int8)))
                for a, z in edges.reshape(-1, 2):
                    keep[own[a] : own[z] if z < n else len(raw)] = False
                new.append(raw[keep].tobytes().decode("utf-8", "replace"))
        made = {text: pa.array(new, pa.string())}
        if stats:
            made |= {"n_words": pa.array(words, pa.int64()), "n_removed": pa.array(gone, pa.int64())}
        yield pa.RecordBatch.from_arrays([made[c] if c in made else b.column(c) for c in columns], columns)
        trim()


def _with_ranges(docs: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``docs`` with each document's ranges as column ``name``; ``text`` is compressed where it had to be shuffled.

    The side that is built into hash tables is the ranges, so texts are neither sorted nor held; a hot id or null ids are split by AQE.
    """
    key = f"{name}_id"
    lists = found.groupBy(F.col("doc_id").alias(key)).agg(F.sort_array(F.collect_set(F.struct("first", "last", "seen_in", "kind"))).alias(name))  # a document's own ranges
    lists = materialize(lists, "ss-lists")
    discard(found)
    if (lists.agg(F.sum(F.size(name) + 1)).first()[0] or 0) <= BROADCAST_RANGES:
        lists = F.broadcast(lists)
    else:
        frames = StructType([StructField(f.name, BinaryType()) if f.name == "text" else f for f in docs.schema])
        docs, lists = docs.mapInArrow(lambda it: _squeezed(it, "text"), frames), lists.hint("shuffle_hash")
    return docs.join(lists, docs["doc_id"].cast("long") == F.col(key), "left").drop(key)


def dedup_substrings(docs: DataFrame, min_words: int = 50, k: int = 5, per_cent: int = 80) -> DataFrame:
    """doc_id, text without its repeats, n_words, n_removed, removed (ranges of words with the document they were seen in).

    See ``find_repeats`` for what is a repeat and for nulls, ties and empty tables. A null text stays null.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    at = _with_ranges(own, find_repeats(own, min_words, k, per_cent), "removed")
    columns = ["doc_id", "text", "n_words", "n_removed", "removed"]
    ddl = "doc_id long, text string, n_words long, n_removed long, removed array<struct<first:bigint,last:bigint,seen_in:bigint,kind:string>>"
    return at.mapInArrow(lambda it: _rewrite(it, columns, "text", "removed", True), ddl)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    ids = F.coalesce(F.array_distinct(F.transform("removed", lambda r: r["seen_in"])), F.array().cast("array<bigint>"))
    return out.select("doc_id", "n_words", "n_removed", ids.alias("seen_in"), "text")


def stage_substrings(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated paragraphs and passages are cut out of the texts; every document stays. A changed text's n_chars is counted anew."""
    name = "ranges" + "_" * max(len(c) for c in docs.columns)
    at = _with_ranges(docs, find_repeats(docs), name)
    columns = [*docs.columns, name]
    out = at.mapInArrow(lambda it: _rewrite(it, columns, "text", name, False), StructType([*docs.schema, at.schema[name]]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(name) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
