"""Training shards of checked binary records, as a Spark data source: ``df.write.format("record_shards")``.

A record is its length as 8 bytes, a check sum of those, the payload, and a check sum of that; the payload
is the usual message of named lists of whole numbers that trainers read. Every task writes files of its own,
one per run of equal ``shard``, and nothing is visible before the driver has written the list of all of
them: a lost, repeated or aborted task leaves no part of a shard to be read. The list has the sizes of the files;
reading makes partitions of about ``PARTITION_BYTES``, of small files many, and decodes the columns of the given schema only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

SHARD = "shard"
BATCH_RECORDS = 1000
# Bytes of a partition that is read, what opening a file counts as, and partitions that files are spread over at least.
PARTITION_BYTES = 1 << 25
OPEN_BYTES = 1 << 17
LEAST_PARTITIONS = 64
# --- fixed values of the record format: the reversed polynomial and the mask of the check sum ---
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
LISTS = T.ArrayType(T.LongType())


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


def masked_crcs(parts: list[bytes]) -> np.ndarray:
    """The masked check sum of every part; all parts go forward together, a byte at a time."""
    table, sizes = _crc_table(), np.array([len(p) for p in parts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    data = np.frombuffer(b"".join(parts), np.uint8)
    crc = np.full(len(parts), 0xFFFFFFFF, np.uint32)
    for at in range(sizes.max(initial=0)):
        n = np.searchsorted(-sizes, -at, side="left")  # parts longer than this place
        crc[:n] = table[(crc[:n] ^ data[starts[:n] + at]) & 0xFF] ^ (crc[:n] >> 8)
    out = np.empty_like(crc)
    out[order] = ~crc
    return ((out >> 15) | (out << 17)) + np.uint32(MASK)


# ---------------------------------------------------------------- payload --
@lru_cache(maxsize=1 << 16)
def _varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def encode(row: dict[str, list[int] | int | None]) -> bytes:
    """A message with a list of whole numbers per name; a null is left out."""
    entries = []
    for name, value in row.items():
        if value is not None:
            numbers = _field(1, b"".join(map(_varint, value if isinstance(value, list) else [value])))
            entries.append(_field(1, _field(1, name.encode()) + _field(2, _field(3, numbers))))
    return _field(1, b"".join(entries))


@lru_cache(maxsize=1 << 12)
def _head(name: str, size: int) -> bytes:
    """What stands before ``size`` bytes of numbers in the entry of a list."""
    entry = _field(1, _field(1, name.encode()) + _field(2, _field(3, _field(1, bytes(size)))))
    return entry[: len(entry) - size]


def _varints(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All numbers one after the other, and where each ends."""
    left = values.astype(np.int64).view(np.uint64)
    sizes = np.ones(len(left), np.int64)
    for group in range(1, 10):
        sizes += left >= np.uint64(1 << 7 * group)
    ends = np.cumsum(sizes)
    out = np.empty(int(sizes.sum()), np.uint8)
    for group in range(sizes.max(initial=0)):
        has = sizes > group
        more = np.where(sizes[has] > group + 1, np.uint64(128), np.uint64(0))
        out[(ends - sizes)[has] + group] = left[has] >> np.uint64(7 * group) & np.uint64(127) | more
    return out.tobytes(), ends


def encode_all(rows: pa.RecordBatch) -> list[bytes]:
    """``encode`` of every row; the numbers of a column are written together."""
    entries: list[list[bytes]] = [[] for _ in range(rows.num_rows)]
    for name, column in zip(rows.schema.names, rows.columns):
        if pa.types.is_list(column.type):
            numbers, counts = column.flatten(), column.value_lengths().fill_null(0)
        else:
            numbers, counts = column.drop_null(), column.is_valid().cast(pa.int32())
        if numbers.null_count:
            raise ValueError(f"{name} holds a list with a null")
        data, ends = _varints(numbers.to_numpy(zero_copy_only=False))
        upto = np.append(0, ends)[np.append(0, np.cumsum(counts.to_numpy()))].tolist()
        for entry, valid, low, high in zip(entries, column.is_valid().to_pylist(), upto, upto[1:]):
            if valid:
                entry.append(_head(name, high - low) + data[low:high])
    return [_field(1, b"".join(entry)) for entry in entries]


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while data[at] > 127:
        value |= (data[at] & 127) << shift
        shift, at = shift + 7, at + 1
    return value | data[at] << shift, at + 1


def _fields(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        if key & 7 != 2:
            raise ValueError(f"unexpected kind of field {key & 7} in a record")
        size, at = _number(data, at)
        yield key >> 3, data[at : at + size]
        at += size


def _numbers(packed: bytes) -> list[int]:
    out, at = [], 0
    while at < len(packed):
        value, at = _number(packed, at)
        out.append(value - (1 << 64) if value >> 63 else value)
    return out


def _short(data: bytes, names: set[str]) -> dict[str, bytes] | None:
    """``_packed`` of a message as ``encode`` writes it, where no length takes more than a byte; none for any other."""
    if len(data) > 129 or data[:1] != b"\n" or data[1] != len(data) - 2:
        return None
    out, at = {}, 2
    while at < len(data):
        body = at + 4 + data[at + 3]
        low, high = body + 6, at + 2 + data[at + 1]
        if data[at] != 10 or data[at + 2] != 10 or data[body] != 18 or data[body + 2] != 26 or data[body + 4] != 10 or low + data[body + 5] != high:
            return None
        name = data[at + 4 : body].decode()
        if name in names:
            out[name] = data[low:high]
        at = high
    return out


def _packed(payload: bytes, names: set[str]) -> dict[str, bytes]:
    """The written numbers of the lists of the wanted names; others are stepped over."""
    try:
        out = _short(payload, names)
    except IndexError:
        out = None
    if out is None:
        out = {}
        for _, features in _fields(payload):
            for _, entry in _fields(features):
                parts = dict(_fields(entry))
                name = parts[1].decode()
                if name in names:
                    out[name] = b"".join(packed for _, packed in _fields(dict(_fields(parts[2])).get(3, b"")))
    return out


def decode(payload: bytes, names: set[str]) -> dict[str, list[int]]:
    """The lists of the wanted names."""
    return {name: _numbers(packed) for name, packed in _packed(payload, names).items()}


def _values(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the lists one after the other, and where those of each list begin and end."""
    if any(part and part[-1] > 127 for part in packed):
        raise ValueError("a list of a record ends inside a number")
    data = np.frombuffer(b"".join(packed), np.uint8)
    last = data < 128
    before = np.append(0, np.cumsum(last))
    ends = before[np.append(0, np.cumsum([len(part) for part in packed], dtype=np.int64))]
    if not len(data):
        return np.empty(0, np.int64), ends
    starts = np.append(0, np.nonzero(last)[0][:-1] + 1)
    shifts = (np.arange(len(data)) - starts[before[:-1]]) * 7
    parts = (data & 127).astype(np.uint64) << shifts.astype(np.uint64)
    return np.add.reduceat(parts, starts).view(np.int64), ends


def decode_all(payloads: list[bytes], names: set[str]) -> dict[str, pa.ListArray]:
    """``decode`` of every payload, as a column per name; null where a payload lacks it."""
    rows, out = [_packed(p, names) for p in payloads], {}
    for name in names:
        values, ends = _values([row.get(name, b"") for row in rows])
        missing = pa.array([name not in row for row in rows], pa.bool_())
        out[name] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values), mask=missing)
    return out


# ---------------------------------------------------------------- records --
def frame(payloads: list[bytes]) -> bytes:
    lengths = [len(p).to_bytes(8, "little") for p in payloads]
    heads, tails = (masked_crcs(parts).astype("<u4") for parts in (lengths, payloads))
    return b"".join(x for n, h, p, t in zip(lengths, heads, payloads, tails) for x in (n, h.tobytes(), p, t.tobytes()))


@lru_cache(maxsize=1 << 16)
def _size(head: bytes) -> int:
    """The length that the head of a record states, -1 if it is damaged; few lengths differ."""
    sound = len(head) == 12 and masked_crcs([head[:8]])[0] == int.from_bytes(head[8:], "little")
    return int.from_bytes(head[:8], "little") if sound else -1


def read_records(stream, name: str) -> Iterator[list[bytes]]:
    """Batches of payloads of a file; anything damaged or cut off is an error."""

    def take(size: int) -> bytes:
        found = stream.read(size)
        if len(found) != size:
            raise ValueError(f"{name} ends inside a record")
        return found

    while True:
        payloads, tails = [], []
        while len(payloads) < BATCH_RECORDS and (head := stream.read(12)):
            if _size(head) < 0:
                raise ValueError(f"{name} has a damaged record length")
            payloads.append(take(_size(head)))
            tails.append(int.from_bytes(take(4), "little"))
        if not payloads:
            return
        if (masked_crcs(payloads) != np.array(tails, np.uint32)).any():
            raise ValueError(f"{name} has a damaged record")
        yield payloads


# ------------------------------------------------------------ data source --
def _lists(fs_root) -> dict[str, dict]:
    """Lists of committed files by name, without those that a later one replaces."""
    from pyarrow import fs

    files, root = fs_root
    found = {}
    for info in files.get_file_info(fs.FileSelector(f"{root}/_committed", allow_not_found=True)):
        if info.base_name.endswith(".json"):
            with files.open_input_stream(info.path) as source:
                found[info.base_name] = json.loads(source.read())
    gone = {old for one in found.values() for old in one["replaces"]}
    return {name: one for name, one in found.items() if name not in gone}


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, str]]


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str, int]]


def _together(files: list[list]) -> list[_Files]:
    """Files with their shards, cut in the order of the list; one of unknown size is a partition of its own."""
    costs = [OPEN_BYTES + (size[0] if size else PARTITION_BYTES) for _, _, *size in files]
    most, out, filled = min(PARTITION_BYTES, -(-sum(costs) // LEAST_PARTITIONS)), [], 0
    for (name, shard, *_), cost in zip(files, costs):
        if not out or filled >= most:
            out.append(_Files([]))
            filled = 0
        out[-1].files.append((name, shard))
        filled += cost
    return out


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.schema = path, schema

    def partitions(self) -> list[_Files]:
        listed = _lists(_open(self.path)).values()
        return _together([file for one in listed for file in one["files"]]) or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        files, root = _open(self.path)
        for name, shard in partition.files:
            yield from self._rows(files, root, name, shard)

    def _rows(self, files, root: str, name: str, shard: str) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        wanted = {f.name for f in self.schema if f.name != SHARD}
        with files.open_input_stream(f"{root}/{name}") as stream:
            for payloads in read_records(stream, name):
                found, columns = decode_all(payloads, wanted), []
                for field in self.schema:
                    if field.name == SHARD:
                        column = pa.array([shard] * len(payloads))
                    elif field.dataType == LISTS:
                        column = found[field.name]
                    else:
                        lists = found[field.name]
                        low = lists.offsets.to_numpy()
                        column = lists.values.take(pa.array(low[:-1], mask=low[1:] == low[:-1]))
                    columns.append(column.cast(schema.field(field.name).type))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        written, sink = [], None

        def close() -> None:
            written[-1] = (*written[-1], sink.tell())
            sink.close()

        try:
            for batch in iterator:
                shards = batch.column(SHARD).to_pylist()
                payloads = encode_all(batch.drop_columns([SHARD]))
                edges = [i for i in range(len(shards)) if i == 0 or shards[i] != shards[i - 1]]
                for low, high in zip(edges, [*edges[1:], len(shards)]):
                    if sink is None or written[-1][1] != shards[low]:
                        if sink is not None:
                            close()
                        written.append((f"part-{uuid.uuid4().hex}.records", shards[low]))
                        sink = files.open_output_stream(f"{root}/{written[-1][0]}")
                    for at in range(low, high, BATCH_RECORDS):
                        sink.write(frame(payloads[at : min(high, at + BATCH_RECORDS)]))
        finally:
            if sink is not None:
                close()
        return _Written(written)

    def commit(self, messages: list[_Written | None]) -> None:
        files, root = _open(self.path)
        replaces = list(_lists((files, root))) if self.overwrite else []
        listed = [file for m in messages if m is not None for file in m.files]
        files.create_dir(f"{root}/_committed", recursive=True)
        # written under another name first, so that a list is there as a whole or not at all
        name = f"{root}/_committed/{uuid.uuid4().hex}"
        with files.open_output_stream(f"{name}.open") as out:
            out.write(json.dumps({"files": listed, "replaces": replaces}).encode())
        files.move(f"{name}.open", f"{name}.json")

    def abort(self, messages: list[_Written | None]) -> None:
        files, root = _open(self.path)
        for name, *_ in (file for m in messages if m is not None for file in m.files):
            files.delete_file(f"{root}/{name}")


class RecordShards(DataSource):
    """Columns are ``shard`` (string), whole numbers and lists of them; reading needs a schema."""

    @classmethod
    def name(cls) -> str:
        return "record_shards"

    @staticmethod
    def _checked(schema: T.StructType) -> T.StructType:
        for field in schema:
            if field.dataType != (T.StringType() if field.name == SHARD else T.LongType()) and (
                field.name == SHARD or not isinstance(field.dataType, T.ArrayType) or field.dataType.elementType != T.LongType()
            ):
                raise ValueError(f"{field.name} must be a {'string' if field.name == SHARD else 'bigint or array<bigint>'}")
        return T.StructType([T.StructField(f.name, LISTS if isinstance(f.dataType, T.ArrayType) else f.dataType) for f in schema])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._checked(schema))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        self._checked(schema)
        if SHARD not in schema.names:
            raise ValueError("rows need a shard")
        return _Writer(self.options["path"], overwrite)


def write_records(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Shards of records; the rows of a shard are brought together first. Lists must not hold nulls; no shard is ""."""
    df.sparkSession.dataSource.register(RecordShards)
    together = df.withColumn(SHARD, F.coalesce(SHARD, F.lit(""))).repartition(SHARD).sortWithinPartitions(SHARD)
    together.write.format("record_shards").mode("overwrite" if overwrite else "append").save(path)


def read_shards(spark, path: str, schema: str | T.StructType) -> DataFrame:
    """The given columns of all committed records; small files share a partition."""
    spark.dataSource.register(RecordShards)
    return spark.read.format("record_shards").schema(schema).load(path)
