"""Links between texts that share a signature: packed exchange, exact filters, verification, and components that lose no link.

Signatures leave the map tasks packed, a binary for each bucket of signatures. The reduce side finds the sets of nodes that share
one; equal sets count once. What follows never makes all pairs of a set, and never sends a node anywhere but to its own sets:

1. ``close_members``: each set is looked at by parity bits (an exact lower bound of the symmetric difference). Nodes that can be
   linked with none of their set leave it; sets of unlike texts that share a common passage vanish here.
2. ``linked_components``, in rounds: each set whose nodes lie in several components gives out pairs that the bits leave possible
   across them, at most a few a node; their texts are compared exactly, and components grow. A set that had few enough such pairs
   to give out all of them is done. The few become more each round, so every possible pair is settled in the end.

A node's text moves only for pairs that are compared, and once for all pairs of a group of up to ``LOCAL_BYTES``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_shuffles, join_ids, materialize
from .components import components
from .tokens import Words, chunks, mix, shingle_sets, trim

U = np.uint64
NO_ID = -(1 << 63)


def bucket_of(sig: np.ndarray, buckets: int) -> np.ndarray:
    return (((sig >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)


def node_hash(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """One number for each document's set of shingle hashes (0 only for an empty set)."""
    sums = np.zeros(n, np.uint64)
    if len(doc):
        begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        with np.errstate(over="ignore"):
            sums[doc[begins]] = mix(np.add.reduceat(mix(h + U(0x51ED270B)), begins)) | U(1)
    return sums.view(np.int64)


def packed(sig: np.ndarray, node: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, tag 0, binary) of (signature, node): counts, the bucket's nodes, and for each signature its 40 low bits and the
    place of its node. A bucket is named by the high bits, so the low ones tell its signatures apart; two that they don't only
    give candidates more."""
    if not len(sig):
        return
    names, place = np.unique(node, return_inverse=True)
    at = bucket_of(sig, buckets)
    order = np.lexsort((place, at))
    at, place, low = at[order], place[order], (sig & U((1 << 40) - 1))[order]
    cut = np.searchsorted(at, np.arange(buckets + 1))
    for k in np.flatnonzero(cut[1:] > cut[:-1]):
        own = slice(cut[k], cut[k + 1])
        new = np.ones(cut[k + 1] - cut[k], bool)
        new[1:] = place[own][1:] != place[own][:-1]
        mine = names[place[own][new]]
        small = np.cumsum(new) - 1
        kind = np.uint16 if len(mine) <= 1 << 16 else np.uint32
        yield int(k), 0, b"".join((np.array([len(mine), len(new)], np.int64).tobytes(), mine.tobytes(), (low[own] >> U(8)).astype(np.uint32).tobytes(), small.astype(kind).tobytes(), (low[own] & U(255)).astype(np.uint8).tobytes()))


def unpacked(raw: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    """(low bits of the signature, node) of one binary of ``packed``."""
    m, n = np.frombuffer(raw, np.int64, 2).tolist()
    kind = np.uint16 if m <= 1 << 16 else np.uint32
    at = 16 + 8 * m
    high = np.frombuffer(raw, np.uint32, n, at)
    place = np.frombuffer(raw, kind, n, at + 4 * n)
    low = np.frombuffer(raw, np.uint8, n, at + 4 * n + kind().itemsize * n)
    return (high.astype(np.uint64) << U(8)) | low, np.frombuffer(raw, np.int64, m, 16)[place]


def member_sets(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (key, node): (name, size) of every distinct set of two nodes or more that share a key, and their nodes one after another."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[new], node[new]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(key)))
    if not len(begin):
        return key.view(np.int64), size, node
    with np.errstate(over="ignore"):
        name = mix(np.add.reduceat(mix(node.view(np.uint64) + U(0x3C6EF372)), begin) + size.astype(np.uint64)).view(np.int64)
    _, first = np.unique(name, return_index=True)
    first = first[size[first] > 1]
    begin, size = begin[first], size[first]
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return name[first], size, node[at]


def earlier(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each (key, document), the least document that has the key."""
    least = doc.copy()
    if len(key):
        order = np.argsort(key, kind="stable")
        begins = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        least[order] = np.repeat(np.minimum.reduceat(doc[order], begins), np.diff(np.append(begins, len(key))))
    return least


def _cuts(at: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Where runs of consecutive places begin, in each of which the other columns are the same; and the end."""
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    for c in same:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), len(at))


def ranges(doc: np.ndarray, at: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Rows of (document, first << 32 | last, least document) for runs [first, last) of places."""
    cut = _cuts(at, doc, by)
    begin = cut[:-1]
    first = at[begin]
    return np.stack([doc[begin], (first << 32) | (first + np.diff(cut)), by[begin]])


def packed_repeats(key: np.ndarray, leader: np.ndarray, doc: np.ndarray, at: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, tag, binary): tag 3 for keys to be met in the bucket of their leader, tag 4 for the ranges that are done.

    Places are in the order of the texts. Keys with the same leader are runs of places: a run is sent once, with its keys. All
    places of a key's least document are sent, since a document of another task may be less.
    """
    least = earlier(key, doc)
    done, left = doc != least, doc == least
    key, where, d, a = key[left], bucket_of(mix(leader[left]), buckets), doc[left], at[left]  # the least of many hashes has no even high bits
    cut = _cuts(a, d, where)
    begin, count = cut[:-1], np.diff(cut)
    order = np.argsort(where[begin], kind="stable")
    begin, count = begin[order], count[order]
    own = np.searchsorted(where[begin], np.arange(buckets + 1))
    for k in np.flatnonzero(own[1:] > own[:-1]):
        b, n = begin[own[k] : own[k + 1]], count[own[k] : own[k + 1]]
        keys = key[np.repeat(b - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        yield int(k), 3, np.concatenate([[len(b)], d[b], a[b], n, keys.view(np.int64)]).astype(np.int64).tobytes()
    if done.any():
        yield int(doc[done][0] % buckets), 4, ranges(doc[done], at[done], least[done]).tobytes()


def _unpacked(flat: np.ndarray) -> np.ndarray:
    """(key, document, place) of the runs of one binary of tag 3."""
    m = int(flat[0])
    doc, first, count = flat[1 : 1 + 3 * m].reshape(3, m)
    keys = flat[1 + 3 * m :]
    return np.stack([keys, np.repeat(doc, count), np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(keys))])


def exchange(rows: DataFrame, label: str) -> DataFrame:
    """(tag, x, y, z, data) from packed rows. Tag 1: a set of nodes that share a signature (x: its name, y: size, data: nodes). Tag 2:
    triples that were sent as such. Tag 4: (document, first << 32 | last, an earlier document with the same keys) for ranges of places,
    from tags 3 and 4. Tag 5: a node (x), its number of elements (y) and parity bits (data)."""

    def meet(table: pa.Table) -> pa.Table:
        got: dict[int, list] = {0: [], 2: [], 3: [], 4: [], 5: []}
        for tag, data in zip(table.column("tag").to_pylist(), table.column("data"), strict=True):
            raw = data.as_buffer()
            got[tag].append(raw if tag == 5 else unpacked(raw) if tag == 0 else _unpacked(np.frombuffer(raw, np.int64)) if tag == 3 else np.frombuffer(raw, np.int64).reshape(3, -1))
        parts = []

        def add(tag: int, cols: np.ndarray, data=None):
            n = cols.shape[1]
            parts.append(pa.Table.from_arrays([pa.array(np.full(n, tag, np.int8)), *map(pa.array, np.ascontiguousarray(cols)), pa.nulls(n, pa.binary()) if data is None else data], schema=schema))

        if got[0]:
            name, size, nodes = member_sets(*(np.concatenate(x) for x in zip(*got[0], strict=True)))
            add(1, np.stack([name, size, size]), binaries(nodes, size))
        if got[2]:
            add(2, np.concatenate(got[2], axis=1))
        if got[3]:
            key, doc, at = np.concatenate(got[3], axis=1)
            least = earlier(key, doc)
            other = doc != least
            add(4, ranges(doc[other], at[other], least[other]))
        if got[4]:
            add(4, np.concatenate(got[4], axis=1))
        if got[5]:
            heads = np.array([np.frombuffer(x, np.int64, 2) for x in got[5]]).T
            add(5, np.concatenate([heads, heads[1:]]), pa.array([x.slice(16).to_pybytes() for x in got[5]], pa.binary()))
        got.clear()
        trim()
        return pa.concat_tables(parts) if parts else schema.empty_table()

    schema = pa.schema([("tag", pa.int8()), ("x", pa.int64()), ("y", pa.int64()), ("z", pa.int64()), ("data", pa.binary())])
    return materialize(rows.groupBy("bucket").applyInArrow(meet, "tag tinyint, x long, y long, z long, data binary"), label)


def binaries(values: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary for each run of ``size`` values."""
    ends = np.concatenate([[0], np.cumsum(size * values.itemsize)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def node_rows(nodes: np.ndarray, doc: np.ndarray, h: np.ndarray, new: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, tag 5, binary) of each new node: its name, its number of elements, its parity bits."""
    cut = np.searchsorted(doc, np.arange(len(nodes) + 1))
    for i in np.flatnonzero(new):
        own = h[cut[i] : cut[i + 1]]
        yield int(int(nodes[i]) % buckets), 5, np.array([nodes[i], len(own)], np.int64).tobytes() + parity_bits(own)


def to_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    k, t, d = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(t, pa.int8()), pa.array(d, pa.binary())], ["bucket", "tag", "data"])


ROWS_DDL = "bucket int, tag tinyint, data binary"


def shingle_hashes(col: pa.Array, nodes: np.ndarray, of: np.ndarray, k: int) -> dict[int, np.ndarray]:
    """The sorted shingle hashes of each node; a text that is not its node's (another row of the same id) is left out."""
    sets: dict[int, np.ndarray] = {}
    for i, j, buf, offs in chunks(col):
        doc, h = shingle_sets(Words(buf, offs, of), k)
        good = node_hash(doc, h, j - i) == nodes[i:j]
        cut = np.searchsorted(doc, np.arange(j - i + 1))
        sets |= {int(nodes[i + m]): np.sort(h[cut[m] : cut[m + 1]]) for m in np.flatnonzero(good)}
    return sets


def linked(u: np.ndarray, v: np.ndarray, per_cent: int) -> bool:
    """Exact Jaccard of two sorted sets."""
    if 100 * min(len(u), len(v)) < per_cent * max(len(u), len(v)) or not len(u):
        return False
    small, large = (u, v) if len(u) <= len(v) else (v, u)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int(np.count_nonzero(large[at] == small))
    return 100 * common >= per_cent * (len(u) + len(v) - common)


def parity_bits(h: np.ndarray) -> bytes:
    """A bit for each bucket of hashes: whether it holds an odd number of the set's elements; two to four buckets an element.

    Where the bits of two sets differ, at least one element is in one set only: the count of such places is a lower bound of the
    symmetric difference, never an estimate. Bits of more buckets fold into those of fewer by XOR of their halves.
    """
    m = max(64, 1 << int(2 * len(h) - 1).bit_length())
    return np.packbits((np.bincount((h & U(m - 1)).astype(np.int64), minlength=m) & 1).astype(bool), bitorder="little").tobytes()


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words folded to ``words`` words."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _by_width(bits: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
    """Of binaries: their widths in words, a matrix for each width, and each one's row in its matrix."""
    raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in bits]
    width = np.array([len(x) for x in raw], np.int64)
    row = np.zeros(len(raw), np.int64)
    tables = {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        row[at] = np.arange(len(at))
        tables[w] = np.stack([raw[i] for i in at])
    return width, tables, row


class Bits:
    """Sizes and parity bits of nodes given by place, and which pairs of places they leave possible."""

    def __init__(self, n: np.ndarray, bits: pa.Array, per_cent: int):
        self.n, self.t = n, per_cent
        self.width, self.tables, self.row = _by_width(bits)
        for w in sorted(self.tables):
            self.tables[w, w] = self.tables[w]
            if w // 2 in self.tables:
                self.tables[w, w // 2] = fold(self.tables[w], w // 2)

    def possible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the bits put the pairs (i, j) apart, or -1 where sizes or bits rule them out."""
        small, large = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        most = (100 - self.t) * (small + large) // (100 + self.t)
        out = np.full(len(i), -1, np.int64)
        ok = np.flatnonzero(100 * small >= self.t * large)
        low = np.minimum(self.width[i[ok]], self.width[j[ok]])
        high = np.maximum(self.width[i[ok]], self.width[j[ok]])
        turn = self.width[i[ok]] > self.width[j[ok]]
        a, b = np.where(turn, j[ok], i[ok]), np.where(turn, i[ok], j[ok])  # a is the narrower one
        for w in np.unique(low).tolist():
            for v in (w, 2 * w):
                mine = np.flatnonzero((low == w) & (high == v))
                step = max(1, (1 << 20) // w)
                for k in range(0, len(mine), step):
                    m = mine[k : k + step]
                    apart = np.bitwise_count(self.tables[w, w][self.row[a[m]]] ^ self.tables[v, w][self.row[b[m]]]).sum(axis=1, dtype=np.int64)
                    good = apart <= most[ok[m]]
                    out[ok[m[good]]] = apart[good]
        return out


def _pairs_of(size: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, i, j) of all pairs of places within each of some runs."""
    first = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    run = np.repeat(np.arange(len(size)), size)
    after = (begin + size)[run] - first - 1
    i = np.repeat(first, after)
    j = np.repeat(first + 1 - (np.cumsum(after) - after), after) + np.arange(after.sum())
    return np.repeat(run, after), i, j


#: Pairs of one task that are looked at by their bits at a time.
PAIRS_AT_ONCE = 1 << 18
#: Sets of more nodes are looked at one by one, from a few of their nodes first.
SMALL_SET, HUBS = 64, 8


def _batches_of(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs [a, z) of sets with some ``PAIRS_AT_ONCE`` pairs together."""
    total = np.concatenate([[0], np.cumsum(size * (size - 1) // 2)])
    a = 0
    while a < len(size):
        z = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS_AT_ONCE, side="right")) - 1)
        yield a, z
        a = z


def _banded(own: np.ndarray, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the nodes first to last - 1 of one set with all that come after them, some ``PAIRS_AT_ONCE`` at a time."""
    rows = max(1, PAIRS_AT_ONCE // len(own))
    for k in range(first, last, rows):
        x = np.arange(k, min(k + rows, last))
        after = len(own) - 1 - x
        yield np.repeat(own[x], after), own[np.repeat(x + 1 - (np.cumsum(after) - after), after) + np.arange(after.sum())]


def _possible_in(bits: Bits, places: np.ndarray, size: np.ndarray, comp: np.ndarray | None, hubs: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(set, i, j, apart) of possible pairs of places in sets given as runs of ``places``; with ``comp`` only across components, with
    ``hubs`` only those of the first nodes of each large set."""
    begin = np.cumsum(size) - size
    small = np.flatnonzero(size <= SMALL_SET)
    for a, z in _batches_of(size[small]):
        run, i, j = _pairs_of(size[small[a:z]], begin[small[a:z]])
        yield from _kept(bits, small[a:z][run], places[i], places[j], comp)
    for s in np.flatnonzero(size > SMALL_SET).tolist():
        own, last = places[begin[s] : begin[s] + size[s]], int(size[s])
        if comp is not None:  # the nodes of the set's largest component come last: they needn't be paired with each other
            names, back, count = np.unique(comp[own], return_inverse=True, return_counts=True)
            rest = back.ravel() == count.argmax()
            own, last = np.concatenate([own[~rest], own[rest]]), int((~rest).sum()) if len(names) > 1 or count[0] > 1 else last
        for i, j in _banded(own, 0, min(last, HUBS) if hubs else last):
            yield from _kept(bits, np.full(len(i), s), i, j, comp)


def _kept(bits: Bits, run: np.ndarray, i: np.ndarray, j: np.ndarray, comp: np.ndarray | None):
    if comp is not None:
        other = comp[i] != comp[j]
        run, i, j = run[other], i[other], j[other]
    apart = bits.possible(i, j)
    good = apart >= 0
    yield run[good], i[good], j[good], apart[good]


def _sets_of(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (sid, node, ...): a row for each node, and the sets (sid, size) as runs of places among those rows."""
    sid, node = table.column("sid").to_numpy(), table.column("node").to_numpy()
    _, first, place = np.unique(node, return_index=True, return_inverse=True)
    order = np.lexsort((node, sid))
    names, size = np.unique(sid, return_counts=True)
    return table.take(pa.array(first)), names, size, place.ravel()[order]


def _dealt(rows: DataFrame, spark, bytes_each: int = 4 << 20, row_bytes: int = 200) -> DataFrame:
    """Rows of (sid, ...) with the task that gets all rows of a set."""
    n = rows.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * row_bytes // bytes_each))
    return rows.withColumn("task", F.pmod(F.xxhash64("sid"), F.lit(tasks)))


def close_members(sets: DataFrame, bits: DataFrame, per_cent: int) -> DataFrame:
    """(sid, node) of sets (sid, data) with only those nodes that the bits leave possible to be linked within their set."""
    spark = sets.sparkSession

    def members(batches):
        for b in batches:
            flat = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column("data")]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("sid").to_numpy(), [len(x) for x in flat])), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64))], ["sid", "node"])

    distinct = sets.groupBy("sid").agg(F.first("data").alias("data"))
    rows = materialize(distinct.mapInArrow(members, "sid long, node long"), "nd-members")

    def fold_all(batches):
        for b in batches:
            own = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column("bits")]
            small = [(fold(x, max(1, len(x) // 2))).tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n"), pa.array(small, pa.binary())], ["node", "n", "bits"])

    half = bits.mapInArrow(fold_all, "node long, n long, bits binary")

    def keep(table: pa.Table) -> pa.Table:
        nodes, names, size, places = _sets_of(table)
        b = Bits(nodes.column("n").to_numpy(), nodes.column("bits").combine_chunks(), per_cent)
        node = nodes.column("node").to_numpy()
        got, begin = [np.zeros(0, np.int64)], np.cumsum(size) - size
        for run, i, j, _ in _possible_in(b, places, size, None, hubs=True):
            got.append(np.unique(np.concatenate([(run << 32) | i, (run << 32) | j])))
        for s in np.flatnonzero(size > SMALL_SET).tolist():  # those that the first nodes of a large set say nothing about
            own = places[begin[s] : begin[s] + size[s]]
            sure = np.isin((s << 32) | own, np.unique(np.concatenate(got)))
            for i, j in _banded(np.concatenate([own[~sure], own[sure]]), 0, int((~sure).sum())):
                for _, x, y, _ in _kept(b, np.full(len(i), s), i, j, None):
                    got.append(np.unique(np.concatenate([(s << 32) | x, (s << 32) | y])))
        left = np.unique(np.concatenate(got))
        trim()
        name, count, own = member_sets((left >> 32).astype(np.uint64), node[left & 0xFFFFFFFF])
        return pa.table({"sid": pa.array(np.repeat(name, count)), "node": pa.array(own)}, schema=schema)

    schema = pa.schema([("sid", pa.int64()), ("node", pa.int64())])
    out = _dealt(rows.join(half, "node"), spark, row_bytes=120).groupBy("task").applyInArrow(keep, "sid long, node long")
    out = materialize(out.distinct(), "nd-close")
    discard(rows)
    return out


#: The first round gives out at most so many pairs a node of a set; each later one four times as many.
PAIRS_A_NODE = 2


def candidates(open_sets: DataFrame, labels: DataFrame | None, bits: DataFrame, per_cent: int, most: int) -> DataFrame:
    """(kind, a, b) of sets (sid, node). Kind 0: pairs of nodes to be compared, across components. Kind 1: sets (a: sid, b: node) that
    had more possible pairs than ``most`` a node, so that they gave out only some: for every node its nearest possible ones."""
    rows, begun = open_sets.join(bits, "node"), labels is not None
    if labels is not None:
        rows = rows.join(labels, "node", "left").select(*rows.columns, F.coalesce("comp", "node").alias("comp"))
    else:
        rows = rows.withColumn("comp", F.col("node"))

    def look(table: pa.Table) -> pa.Table:
        nodes, names, size, places = _sets_of(table)
        b = Bits(nodes.column("n").to_numpy(), nodes.column("bits").combine_chunks(), per_cent)
        node, comp = nodes.column("node").to_numpy(), nodes.column("comp").to_numpy()
        out, begin = [np.zeros((3, 0), np.int64)], np.cumsum(size) - size
        held: set[int] = set(np.flatnonzero(size > SMALL_SET).tolist()) if not begun else set()
        for run, i, j, apart in _possible_in(b, places, size, comp, hubs=not begun):
            count = np.bincount(run, minlength=len(size))
            full = (count > most * size)[run] | ((size > SMALL_SET)[run] & (not begun))
            out.append(_ordered(0, node[i[~full]], node[j[~full]]))
            if full.any():
                # of either side of each pair, the nearest ones of a node within its set
                r, x, y, d = (np.concatenate(z) for z in ((run[full],) * 2, (i[full], j[full]), (j[full], i[full]), (apart[full],) * 2))
                order = np.lexsort((node[y], d, x, r))
                r, x, y = r[order], x[order], y[order]
                new = np.ones(len(r), bool)
                new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
                at = np.flatnonzero(new)
                rank = np.arange(len(r)) - np.repeat(at, np.diff(np.append(at, len(r))))
                near = rank < most
                out.append(_ordered(0, node[x[near]], node[y[near]]))
                held |= set(np.unique(r).tolist())
        for s in sorted(held):
            own = node[places[begin[s] : begin[s] + size[s]]]
            out.append(np.stack([np.ones(len(own), np.int64), np.full(len(own), names[s]), own]))
        flat = np.unique(np.concatenate(out, axis=1), axis=1) if len(out) > 1 else out[0]
        return pa.table({"kind": pa.array(flat[0].astype(np.int8)), "a": pa.array(flat[1]), "b": pa.array(flat[2])}, schema=schema)

    schema = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64())])
    return materialize(_dealt(rows, open_sets.sparkSession, row_bytes=200).groupBy("task").applyInArrow(look, "kind tinyint, a long, b long").distinct(), "nd-look")


def _ordered(kind: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([np.full(len(a), kind, np.int64), np.minimum(a, b), np.maximum(a, b)])


#: The texts of a group of pairs to be compared meet in one task up to so many bytes; of a larger one they are joined pair by pair.
LOCAL_BYTES = 16 << 20


def compared(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], of: np.ndarray, k: int, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose texts are linked. ``texts`` gives (node, text) for given nodes."""
    spark = pairs.sparkSession
    groups = components(pairs).withColumnRenamed("comp", "grp")
    found = materialize(texts(groups).join(groups, "node"), "nd-texts")
    sizes = found.groupBy("grp").agg(F.sum(F.octet_length("text")).alias("bytes"))
    large = materialize(sizes.filter(F.col("bytes") > LOCAL_BYTES).select("grp"), "nd-large")
    n_large = large.count()
    named = pairs.join(groups.select(F.col("node").alias("a"), "grp"), "a")
    total = found.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = F.lit(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (2 << 20))))
    small, own = (found, named) if not n_large else (join_ids(x, large, "grp", "left_anti", n_large) for x in (found, named))

    def local(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        sets = shingle_hashes(left.column("text").combine_chunks(), left.column("node").to_numpy(), of, k)
        trim()
        good = [x in sets and y in sets and linked(sets[x], sets[y], per_cent) for x, y in zip(right.column("a").to_pylist(), right.column("b").to_pylist(), strict=True)]
        return right.select(["a", "b"]).filter(pa.array(good, pa.bool_())).cast(schema)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    by = F.pmod(F.xxhash64("grp"), tasks).alias("task")
    out = small.select(by, "node", "text").groupBy("task").cogroup(own.select(by, "a", "b").groupBy("task")).applyInArrow(local, "a long, b long")
    if n_large:
        rest = join_ids(named, large, "grp", "left_semi", n_large).select("a", "b")
        out = out.unionByName(joined(rest, join_ids(found, large, "grp", "left_semi", n_large).select("node", "text"), of, k, per_cent))
    out = materialize(out, "nd-links")
    discard(found, large, groups)
    return out


def joined(pairs: DataFrame, texts: DataFrame, of: np.ndarray, k: int, per_cent: int) -> DataFrame:
    """The same by joins alone, for groups of any size; adaptive execution splits a node of many pairs."""
    t = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    u = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def check(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                rows = batch.slice(first, 1000)
                a, b = (rows.column(c).to_numpy() for c in ("a", "b"))
                x, y = (shingle_hashes(rows.column(c), n, of, k) for c, n in (("text_a", a), ("text_b", b)))
                good = [int(i) in x and int(j) in y and linked(x[int(i)], y[int(j)], per_cent) for i, j in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(t, "a").join(u, "b").select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def linked_components(sets: DataFrame, bits: DataFrame, texts: Callable[[DataFrame], DataFrame], of: np.ndarray, k: int, per_cent: int) -> DataFrame:
    """(node, comp) of every node that has a link: exact Jaccard of k-word shingle sets, per_cent / 100 or more.

    ``sets`` (sid, data): nodes that share a signature; a pair is linked only if it does. ``bits`` (node, n, bits): sizes and
    parity bits, a row a node. ``texts`` gives (node, text) for given nodes.
    """
    spark = sets.sparkSession
    at = close_members(sets, bits, per_cent)
    free_shuffles(spark)
    labels, links, tried, most = None, None, None, PAIRS_A_NODE
    while True:
        looked = candidates(at, labels, bits, per_cent, most)
        discard(at)
        at = materialize(looked.filter("kind = 1").select(F.col("a").alias("sid"), F.col("b").alias("node")), "nd-open")
        pairs = looked.filter("kind = 0").select("a", "b")
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "nd-pairs")
        discard(looked)
        if not pairs.isEmpty():
            good = compared(pairs, texts, of, k, per_cent)
            old = (links, tried, labels)
            links = good if links is None else materialize(links.unionByName(good), "nd-links")
            tried = pairs if tried is None else materialize(tried.unionByName(pairs), "nd-tried")
            labels = components(links)
            if old[0] is not None:
                discard(*old, good, pairs)
        free_shuffles(spark)
        if at.isEmpty():
            break
        most *= 4
    discard(at, links, tried)
    return labels if labels is not None else materialize(spark.createDataFrame([], "node long, comp long"), "nd-none")
