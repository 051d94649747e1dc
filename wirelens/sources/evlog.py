"""The event log: a magic number, then length-prefixed binary records; reader, writer and decoding.

`read_logs` and `write_logs` work on any path that Spark opens, in batch or as a stream: executors need no folder of their
own. The records of a file can't be told apart without reading it from the start, so a file is read by one task; the
writer starts a new file every FILE_BYTES. `spark.read.format("evlog")` is the same as a data source for storage that all
executors mount.

Records are decoded a whole Arrow batch at once: the records of a kind are gathered into one array of fixed layout, whose
fields are views of it.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import scalars as S

#: Fixed value: the first bytes of a log.
MAGIC = b"OBSEVL1\n"
SCHEMA = "file string, seq long, rec binary"
SECRET_RECORDS = (3, 4)
#: Byte offset and size of the captured text in an I/O record, and where its length stands.
TEXT_AT, TEXT_SIZE, LENGTH_AT = 40, 256, 2


class LogError(ValueError):
    pass


def records(data: bytes) -> Iterator[bytes]:
    """The records of a log. An end within a length is the end; one within a record is an error."""
    if data[: len(MAGIC)] != MAGIC:
        raise LogError("not an event log")
    at = len(MAGIC)
    while at + 4 <= len(data):
        (size,) = struct.unpack_from("<I", data, at)
        at += 4
        if at + size > len(data):
            raise LogError("the log ends within a record")
        yield data[at : at + size]
        at += size


def framed(rec: bytes) -> bytes:
    return struct.pack("<I", len(rec)) + rec


_SECRETS = (b"authorization:", b"cookie:", b"set-cookie:", b"api-key:")


def starred(text: bytes) -> bytes:
    """The values of secret headers as asterisks, byte for byte."""
    out, low = bytearray(text), text.lower()
    for name in _SECRETS:
        at = low.find(name)
        while at >= 0:
            start = at + len(name)
            while start < len(out) and out[start] in b" \t":
                start += 1
            end = start
            while end < len(out) and out[end] not in b"\r\n":
                end += 1
            out[start:end] = b"*" * (end - start)
            at = low.find(name, max(end, at + 1))
    return bytes(out)


def redacted(rec: bytes) -> bytes:
    """An I/O record with the captured text's secrets starred; any other record as it is."""
    if rec and rec[0] in SECRET_RECORDS and len(rec) >= TEXT_AT + TEXT_SIZE:
        return rec[:TEXT_AT] + starred(rec[TEXT_AT : TEXT_AT + TEXT_SIZE]) + rec[TEXT_AT + TEXT_SIZE :]
    return rec


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_File(p) for p in (sorted(glob.glob(os.path.join(self.path, "*"))) if os.path.isdir(self.path) else [self.path])]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            for seq, rec in enumerate(records(f.read())):
                yield partition.path, seq, rec


@dataclass
class _Written(WriterCommitMessage):
    path: str
    n: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows):
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        task = TaskContext.get()
        name, n = os.path.join(self.path, f"part-{task.partitionId():05d}-{task.taskAttemptId()}.evlog"), 0
        fd = os.open(name, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)  # never an old file, never open to others
        with os.fdopen(fd, "wb") as f:
            f.write(MAGIC)
            for row in rows:
                f.write(framed(redacted(bytes(row["rec"]))))
                n += 1
        return _Written(name, n)


class EventLog(DataSource):
    """A path on storage that all executors mount."""

    @classmethod
    def name(cls):
        return "evlog"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventLog)


#: Bytes of one written file, about.
FILE_BYTES = 32 << 20


def write_logs(rows: DataFrame, path: str) -> None:
    """Appends log files with the records of rows (rec), redacted, under any path that Spark writes to.

    Spark's text writer does it: the magic number's last byte is the end of a line, and the rest of a file, with all its
    records, is one more line, whose end is too short for another record's length.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        file = lambda: pa.RecordBatch.from_arrays([pa.array([MAGIC[:-1], b"".join(held)], pa.binary())], ["value"])
        for batch in batches:
            for rec in batch.column("rec").to_pylist():
                held.append(framed(redacted(rec)))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield file()
                    held, size = [], 0
        if held:
            yield file()

    lines = rows.where("rec IS NOT NULL").select("rec").mapInArrow(chunks, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.mode("append").option("lineSep", "\n").option("maxRecordsPerFile", 2).text(path)


def read_logs(spark: SparkSession, path: str, stream: bool = False, files_per_batch: int = 1) -> DataFrame:
    """file, seq, rec: the records of logs under any path that Spark's readers open; empty files have none."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = list(records(data)) if data else []
                for low in range(0, len(rows), 10_000):
                    part = rows[low : low + 10_000]
                    columns = [pa.array([name] * len(part)), pa.array(np.arange(low, low + len(part))), pa.array(part, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["file", "seq", "rec"])

    if stream:
        files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        files = files.option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(path)
    else:
        files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(split, SCHEMA)


def _layout(size: int, **fields: tuple[str, int]) -> np.dtype:
    return np.dtype({"names": list(fields), "formats": [f for f, _ in fields.values()], "offsets": [at for _, at in fields.values()], "itemsize": size})


# Sizes, and type and byte offset of each field.
IO = _layout(
    296, kind=("u1", 0), dir=("u1", 1), length=("<u2", 2), fd=("<i4", 4), pid=("<u4", 8), tgid=("<u4", 12), ret=("<i8", 16), ts_ns=("<i8", 24), cgroup_id=("<i8", 32),
    text=(f"S{TEXT_SIZE}", TEXT_AT),
)
SOCKET = _layout(
    48, kind=("u1", 0), pid=("<u4", 8), tgid=("<u4", 12), ret=("<i8", 16), latency_ns=("<i8", 24), ts_ns=("<i8", 32), daddr_be=("<u4", 40), dport_be=("<u2", 44)
)
TIMES = _layout(32, kind=("u1", 0), dir=("u1", 1), fd=("<i4", 4), pid=("<u4", 8), tgid=("<u4", 12), ret=("<i8", 16), ts_ns=("<i8", 24))
HANDSHAKE = _layout(48, kind=("u1", 0), pid=("<u4", 8), tgid=("<u4", 12), fd=("<i4", 16), ret=("<i8", 24), latency_ns=("<i8", 32), ts_ns=("<i8", 40))
STACK = _layout(96, kind=("u1", 0), tgid=("<u4", 8), pid=("<u4", 12), ts_ns=("<i8", 16), n=("u1", 24), ips=("(8,)<i8", 32))
FILE_OP = _layout(160, kind=("u1", 0), op=("u1", 1), pid=("<u4", 4), tgid=("<u4", 8), ts_ns=("<i8", 16), cgroup_id=("<i8", 24), path=("S128", 32))


def gathered(column: pa.Array, layout: np.dtype, kinds: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Which records of a batch are of these kinds and long enough, and these as one array; others are unknown or cut off."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    chosen = np.flatnonzero(np.diff(offsets) >= layout.itemsize)
    chosen = chosen[np.isin(data[offsets[chosen]], kinds)]
    raw = data[offsets[chosen][:, None] + np.arange(layout.itemsize)]
    return chosen, np.ascontiguousarray(raw).view(layout).reshape(-1)


def _bytes(rows: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of the first sizes[k] bytes of each of rows (records x width bytes)."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = rows[np.arange(rows.shape[1]) < sizes[:, None]]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _raw(r: np.ndarray, at: int, size: int) -> np.ndarray:
    return r.view(np.uint8).reshape(len(r), r.dtype.itemsize)[:, at : at + size]


_DIRECTION = np.array([None, *S.DIRECTIONS.values()], object)
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _stack_ips(r: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(r["n"], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, r["ips"][np.arange(8) < r["n"][:, None]])


#: What isn't a plain number: how a column is made of the gathered records.
_MADE = {
    "dir": lambda r: pa.array(_DIRECTION[np.where(r["dir"] <= 2, r["dir"], 0)], pa.string()),
    "prefix_len": lambda r: pa.array(np.minimum(r["length"], TEXT_SIZE), pa.int32()),
    "prefix": lambda r: _bytes(_raw(r, TEXT_AT, TEXT_SIZE), np.minimum(r["length"], TEXT_SIZE)),
    "ips": _stack_ips,
    "path": lambda r: _bytes(_raw(r, 32, 128), np.full(len(r), 128)),
}


def _decoded(df: DataFrame, layout: np.dtype, kinds: tuple[int, ...], schema: str, valid=None) -> DataFrame:
    """The columns of df but rec, and those of schema, for the records of some kinds."""
    kept = [c for c in df.columns if c != "rec"]
    columns = [tuple(c.split()) for c in schema.split(", ")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen, r = gathered(batch.column("rec"), layout, kinds)
            if valid is not None:
                ok = valid(r)
                chosen, r = chosen[ok], r[ok]
            made = [_MADE[c](r) if c in _MADE else pa.array(r[c].astype(np.int64), pa.int64()).cast(_TYPES[t]) for c, t in columns]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(chosen)) for c in kept], *made], [*kept, *[c for c, _ in columns]])

    plain = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*kept).schema)
    return df.mapInArrow(decode, f"{plain}, {schema}")


IO_SCHEMA = "kind int, dir string, prefix_len int, fd int, pid long, tgid long, ret long, ts_ns long, cgroup_id long, prefix binary"


def decode_io(df: DataFrame) -> DataFrame:
    """Kinds 3 and 4. The captured text is cut at its length (at most 256 bytes)."""
    return _decoded(df, IO, (3, 4), IO_SCHEMA)


def decode_socket(df: DataFrame) -> DataFrame:
    return _decoded(df, SOCKET, (1, 2), "kind int, pid long, tgid long, ret long, latency_ns long, ts_ns long, daddr_be long, dport_be int")


def decode_times(df: DataFrame) -> DataFrame:
    return _decoded(df, TIMES, (5,), "dir string, fd int, pid long, tgid long, ret long, ts_ns long")


def decode_handshake(df: DataFrame) -> DataFrame:
    return _decoded(df, HANDSHAKE, (6,), "pid long, tgid long, fd int, ret long, latency_ns long, ts_ns long")


def decode_stacks(df: DataFrame) -> DataFrame:
    """Kind 7; more than 8 frames is no record. The process id stands before the thread's here."""
    return _decoded(df, STACK, (7,), "tgid long, pid long, ts_ns long, ips array<long>", lambda r: r["n"] <= 8)


def decode_file_ops(df: DataFrame) -> DataFrame:
    found = _decoded(df, FILE_OP, (8,), "op int, pid long, tgid long, ts_ns long, cgroup_id long, path binary")
    return found.withColumn("path", S.c_string(F.col("path")))


def encode(rows: DataFrame, layout: np.dtype) -> DataFrame:
    """seq, rec: records of a layout, its fields from the columns of the same names (dir as R or W, texts as ISO-8859-1); others are 0."""
    fields = [n for n in layout.names if n in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = np.zeros(batch.num_rows, layout)
            for name in fields:
                column = batch.column(name)
                if name == "dir":
                    r[name] = [1 if d == "R" else 2 if d == "W" else 0 for d in column.to_pylist()]
                elif name in ("text", "path"):
                    found = [(t or "").encode("latin-1", "replace") for t in column.to_pylist()]
                    r[name] = found
                    if "length" in layout.names:
                        r["length"] = np.minimum([len(t) for t in found], TEXT_SIZE)
                elif name == "ips":
                    for k, ips in enumerate(column.to_pylist()):
                        r[name][k, : len(ips)] = ips[:8]
                        r["n"][k] = len(ips)
                else:
                    r[name] = column.to_numpy(zero_copy_only=False)
            offsets = (np.arange(len(r) + 1) * layout.itemsize).astype(np.int32)
            rec = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(offsets), pa.py_buffer(r.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("seq"), rec], ["seq", "rec"])

    seq = rows.select("seq").schema[0].dataType.simpleString()
    return rows.select("seq", *fields).mapInArrow(run, f"seq {seq}, rec binary")


def encode_io(m: DataFrame) -> DataFrame:
    """seq, rec: I/O records (kind 3, or 4 with tls) of rows seq, tgid, pid, fd, dir, ret, ts_ns, cgroup_id, text, tls."""
    return encode(m.withColumn("kind", F.when(F.col("tls"), 4).otherwise(3)), IO)


def little_endian(value, size: int):
    """A number as little-endian bytes."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    parts = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: F.substring(digits, F.lit(17) - k * 2, F.lit(2)))
    return F.unhex(F.array_join(parts, ""))
