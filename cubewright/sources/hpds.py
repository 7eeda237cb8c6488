"""Binary key datasets, JSON query specifications and JSON results."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: magic, then the count and (key low, key high, value) as little-endian 64-bit words.
MAGIC = b"HPDS0001"
HEADER, RECORD = "<8sQ", "<QQQ"


def write_dataset(path: str, records: Iterator[tuple[int, int]], n: int) -> None:
    """Write n records (key of up to 128 bits, value) to one local file."""
    with open(path, "wb") as f:
        f.write(struct.pack(HEADER, MAGIC, n))
        for key, value in records:
            f.write(struct.pack(RECORD, key & (1 << 64) - 1, key >> 64, value))


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(key_lo, key_hi, value) as BIGINTs of every record of the files at ``path``.

    A file is read by one task as a stream of record blocks; another magic, or a file shorter than its count, is an error.
    """

    def unpack(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                raw = content.as_buffer()
                magic, n = struct.unpack_from(HEADER, raw) if len(raw) >= 16 else (b"", 0)
                if magic != MAGIC:
                    raise ValueError(f"{name}: no dataset")
                if len(raw) < 16 + 24 * n:
                    raise ValueError(f"{name}: cut short")
                words = np.frombuffer(raw, dtype="<i8", offset=16, count=3 * n).reshape(-1, 3)
                for i in range(0, n, 1 << 16):
                    part = words[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(part[:, j].copy()) for j in range(3)], ["key_lo", "key_hi", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(unpack, "key_lo long, key_hi long, value long")


#: The parts of a query specification by query, with what each holds.
SPEC_KEYS = ("n_records", "point_lookup_keys", "narrow_range", "wide_range", "range_agg", "dim_filter", "multi_dim_filter", "insert_keys", "insert_values", "delete_keys", "hypercube", "groupby", "correlated", "moving_windows", "moving", "adhoc_drills")


def _wide(x):
    """[low, high] word pairs under the names that hold keys become integers."""
    return x[0] | (x[1] << 64) if isinstance(x, list) and len(x) == 2 and all(isinstance(i, int) for i in x) else x


def read_spec(path: str) -> dict:
    """A query specification; keys given as word pairs become integers."""
    with open(path) as f:
        spec = json.load(f)
    for name in ("point_lookup_keys", "insert_keys", "delete_keys"):
        spec[name] = [_wide(k) for k in spec.get(name, [])]
    for name in ("narrow_range", "wide_range", "range_agg"):
        if name in spec:
            spec[name] |= {end: _wide(spec[name][end]) for end in ("lo", "hi")}
    spec["moving_windows"] = [{end: _wide(w[end]) for end in ("lo", "hi")} for w in spec.get("moving_windows", [])]
    return spec


def write_spec(path: str, spec: dict) -> None:
    pair = lambda k: [k & (1 << 64) - 1, k >> 64]
    out = dict(spec)
    for name in ("point_lookup_keys", "insert_keys", "delete_keys"):
        out[name] = [pair(k) for k in spec.get(name, [])]
    for name in ("narrow_range", "wide_range", "range_agg"):
        if name in spec:
            out[name] = spec[name] | {end: pair(spec[name][end]) for end in ("lo", "hi")}
    out["moving_windows"] = [{end: pair(w[end]) for end in ("lo", "hi")} for w in spec.get("moving_windows", [])]
    with open(path, "w") as f:
        json.dump(out, f)


def write_results(path: str, tree: str, dataset: str, results: list[dict]) -> None:
    """Results of a run: for each query its name, elapsed_ms, count, sum, checksum and extra."""
    fields = ("name", "elapsed_ms", "count", "sum", "checksum", "extra")
    with open(path, "w") as f:
        json.dump({"tree": tree, "dataset": dataset, "queries": [{k: r.get(k) for k in fields} for r in results]}, f, indent=1)


def results_frame(spark: SparkSession, path: str) -> DataFrame:
    """The queries of a result file as rows."""
    return spark.read.json(path, multiLine=True).select("tree", "dataset", F.explode("queries").alias("q")).select("tree", "dataset", "q.*")
