"""Shards of records: check sums, round trips, damage, and jobs that fail."""

from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from affinis.sources import record_shards as rs

SCHEMA = "shard string, ids array<bigint>, label bigint"
ROWS = [("a", [1, 2, 300], 7), ("a", [], -1), ("b", [2**63 - 1, -(2**63)], 0), ("a", None, None), ("c", [0] * 200, 5)]


def test_check_sums():
    """A published value, and parts of all lengths against one byte at a time."""
    masked = rs.masked_crcs([b"123456789", b""])
    plain = [0xE3069283, 0]
    assert masked.tolist() == [(((c >> 15 | c << 17) & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF for c in plain]
    parts = [bytes(range(n)) for n in (5, 0, 9, 5, 1)]
    assert rs.masked_crcs(parts).tolist() == [int(rs.masked_crcs([p])[0]) for p in parts]


def test_known_message():
    assert rs.encode({"x": 1}) == bytes([10, 12, 10, 10, 10, 1]) + b"x" + bytes([18, 5, 26, 3, 10, 1, 1])


def shown(df):
    return sorted(map(repr, df.collect()))


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = str(tmp_path / "out")
    rs.write_records(df, path)
    back = rs.read_shards(spark, path, SCHEMA)
    assert shown(back) == shown(df)
    assert len(list(Path(path).glob("*.records"))) == 3  # one per shard
    assert shown(rs.read_shards(spark, path, "label bigint")) == shown(df.select("label"))
    rs.write_records(df.limit(2), path)
    assert rs.read_shards(spark, path, SCHEMA).count() == 7
    rs.write_records(df.limit(1), path, overwrite=True)
    assert rs.read_shards(spark, path, SCHEMA).count() == 1
    rs.write_records(df.limit(0), path, overwrite=True)
    assert rs.read_shards(spark, path, SCHEMA).count() == 0


def test_damage_is_an_error(spark, tmp_path):
    path = str(tmp_path / "out")
    rs.write_records(spark.createDataFrame(ROWS[:1], SCHEMA), path)
    (file,) = Path(path).glob("*.records")
    whole = file.read_bytes()
    for damaged in (whole[:-1], whole[:20], whole[:5], *(whole[:i] + bytes([whole[i] ^ 1]) + whole[i + 1 :] for i in (0, 9, 15, len(whole) - 1))):
        with file.open("rb") as stream, pytest.raises(ValueError):
            file.write_bytes(damaged)
            list(rs.read_records(stream, "file"))
    with pytest.raises(Exception, match="damaged record"):
        rs.read_shards(spark, path, SCHEMA).collect()


def test_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    good = spark.range(0, 50, 1, 4).select(F.lit("a").alias("shard"), F.col("id").alias("label"))
    rs.write_records(good, path)
    fails = good.withColumn("label", F.when(F.col("label") == 49, F.raise_error(F.lit("stop")).cast("bigint")).otherwise(F.col("label")))
    with pytest.raises(Exception, match="stop"):
        fails.write.format("record_shards").mode("append").save(path)
    assert rs.read_shards(spark, path, "label bigint").count() == 50


def test_other_types_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="bigint"):
        rs.write_records(spark.createDataFrame([("a", "x")], "shard string, label string"), str(tmp_path / "out"))


def test_small_files_share_a_partition(spark, tmp_path):
    """300 shards of one record are read in no more than 64 tasks, each record once with its own shard."""
    path = str(tmp_path / "out")
    rs.write_records(spark.range(300).select(F.concat(F.lit("s"), "id").alias("shard"), F.col("id").alias("label")), path)
    back = rs.read_shards(spark, path, "shard string, label bigint")
    assert len(list(Path(path).glob("*.records"))) == 300 and back.rdd.getNumPartitions() <= 64
    assert sorted(map(tuple, back.collect())) == sorted((f"s{i}", i) for i in range(300))
    # lists that were written without sizes
    assert [p.files for p in rs._together([["a", "x"], ["b", "y"]])] == [[("a", "x")], [("b", "y")]]


def test_columns_as_single_rows():
    """Whole columns are encoded and decoded as row by row, with long lists, numbers of all sizes and nulls."""
    edges = [0, 127, 128, 2**14 - 1, 2**14, 2**62, 2**63 - 1, -1, -(2**63)]
    rows = [{"a": edges, "b": 5}, {"a": [], "b": None}, {"a": None, "b": -7}, {"a": list(range(300)), "b": 2**40}, {"a": None, "b": None}]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("a", pa.list_(pa.int64())), ("b", pa.int64())]))
    payloads = rs.encode_all(batch)
    assert payloads == [rs.encode(r) for r in rows]
    assert rs.encode_all(batch.slice(1, 3)) == payloads[1:4]
    found = rs.decode_all(payloads, {"a", "b", "c"})
    for name, column in found.items():
        assert column.to_pylist() == [rs.decode(p, {name}).get(name) for p in payloads]
    assert found["a"].to_pylist() == [r["a"] for r in rows] and found["c"].to_pylist() == [None] * 5
