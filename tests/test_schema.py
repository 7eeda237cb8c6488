import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cubewright.functions.checksum import GOLDEN, fold_key, group_checksum, results_match
from cubewright.functions.schema import CubeSchema, Dimension, orders_schema, sales_schema


def test_default_layout():
    s = sales_schema()
    assert s.total_bits == 56
    assert s.offsets == {"year": 48, "month": 44, "day": 39, "state": 34, "product": 29, "price": 10, "version": 0}
    assert orders_schema().total_bits == 61


def test_encode_clamps_and_truncates(spark):
    d = Dimension("price", 8, base=10, scale=100)
    rows = spark.createDataFrame([(0.0,), (0.119,), (0.5,), (99.0,), (None,)], "x double")
    assert [r[0] for r in rows.select(d.encode_float(F.col("x"))).collect()] == [0, 1, 40, 254, None]
    free = Dimension("x", 8, nullable=False)
    assert spark.range(1).select(free.encode(F.lit(999))).first()[0] == 255


def test_dictionary(spark):
    d = sales_schema().dim("state")
    rows = spark.createDataFrame([("AZ",), ("WA",), ("??",), (None,)], "s string")
    assert [r[0] for r in rows.select(d.encode_string(F.col("s"))).collect()] == [0, 14, None, None]
    assert [r[0] for r in rows.select(d.encode_string(F.col("s"), unknown_as_zero=True)).collect()] == [0, 14, 0, None]
    assert spark.range(15).select(d.decode_string(F.col("id"))).collect()[1][0] == "CA"


codes = st.tuples(*[st.integers(0, d.mask) for d in sales_schema().dims])


@settings(max_examples=50, deadline=None)
@given(codes, codes)
def test_keys_keep_the_order_of_codes(a, b):
    s = sales_schema()
    ka, kb = (s.pack(dict(zip(s.names, x, strict=True))) for x in (a, b))
    assert (ka < kb) == (a < b)
    assert tuple(s.unpack(ka).values()) == a


def test_round_trip_in_spark(spark):
    s = sales_schema()
    rows = spark.createDataFrame([(22, 9, 14, 1, 5, 120000, 100, 1), (22, None, 14, 1, 5, 0, 0, 2)], ", ".join(f"{n} long" for n in [*s.names, "value"]))
    keyed = rows.withColumn("key", s.key())
    got = keyed.select("value", *[s.extract(n).alias(n) for n in s.names]).orderBy("value").collect()
    assert [got[0][n] for n in s.names] == [22, 9, 14, 1, 5, 120000, 100]
    assert got[1]["month"] == s.dim("month").null_code
    assert keyed.orderBy("value").first()["key"] == s.pack(dict(zip(s.names, (22, 9, 14, 1, 5, 120000, 100), strict=True)))


def test_wide_keys_are_ordered_bytes(spark):
    s = CubeSchema((Dimension("a", 40), Dimension("b", 40)))
    rows = spark.createDataFrame([(1, 5), (2, 0), (0, 7)], "a long, b long").withColumn("key", s.key())
    got = rows.orderBy("key").collect()
    assert [r["a"] for r in got] == [0, 1, 2]
    assert int.from_bytes(got[1]["key"], "big") == s.pack({"a": 1, "b": 5})


def test_bad_schemas():
    with pytest.raises(ValueError):
        CubeSchema(())
    with pytest.raises(ValueError):
        CubeSchema(tuple(Dimension(f"d{i}", 4) for i in range(9)))


def test_checksums():
    assert fold_key(5) == 5
    assert fold_key(1 << 64) == GOLDEN
    assert group_checksum({0: 7, 1: 0}) == 7 ^ GOLDEN
    assert results_match(1, 1e9, 3, 1, 1e9 + 500, 3) and not results_match(1, 1e9, 3, 2, 1e9, 3)
