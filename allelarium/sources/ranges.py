"""Data sources that read one large file in many tasks, by byte ranges.

`block_gzip_lines`: the lines of a gzip file. A file of gzip blocks that state
their size (BGZF) is cut into ranges of compressed bytes, one for a task: it
finds the first block that begins in its range, inflates the blocks that begin
in it, leaves out the line it starts in and reads its last line to the end,
wherever that lies. Any other gzip file is inflated as a stream by one task.

`plink_cells`: the cells of a PLINK file set. A task has a byte range of the
.bim, whose lines are counted beforehand by Spark, and the rows of the .bed
that belong to them, so variants and genotypes meet without a join.

Files are opened with pyarrow's file systems (local, hdfs, s3, gs) by the task
that reads them, and only the bytes of its range are read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of one range; bytes read at a time; cells and lines of one batch.
RANGE_BYTES, READ_BYTES, BATCH_CELLS, BATCH_LINES = 32 << 20, 1 << 20, 1 << 20, 4096


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        path = re.sub("^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def open_file(path: str) -> pa.NativeFile:
    fs, at = locate(path)
    return fs.open_input_file(at)


@dataclass
class Range(InputPartition):
    """Bytes start:end of the file; `first` numbers the first row that begins there, and there are `rows` of them. With `first` -1 virtual offsets."""

    start: int
    end: int
    first: int = 0
    rows: int = 0


def ranges_of(size: int, each: int) -> list[Range]:
    return [Range(lo, min(size, lo + each)) for lo in range(0, size, each)]


def lines_from(f: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    """The lines of a plain file whose first byte is in start:end."""
    at, held = max(0, start - 1), b""
    skip = start > 0  # up to the first line end, which may be the byte before
    place = at
    size = f.size()
    while at < size:
        got = f.read_at(READ_BYTES, at)
        at += len(got)
        *whole, held = (held + got).split(b"\n")
        for line in whole:
            if not skip:
                if place >= end:
                    return
                yield line
            skip = False
            place += len(line) + 1
        if place >= end and not skip:
            return
    if held and not skip and place < end:
        yield held


# gzip of blocks


def block_size(head: bytes) -> int:
    """Bytes of the block that begins with `head`, from the BC field of its header; 0 if it is no such block."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    at, stop = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= min(stop, len(head)):
        n = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and n == 2 and at + 6 <= len(head):
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + n
    return 0


#: Bytes that hold a block's header, its extra field and what follows; a block has 64 KiB at most.
_HEAD, _BLOCK = 1 << 10, 1 << 16


def _is_block(data: bytes, n: int) -> bool:
    """One whole member of gzip with the right checksum."""
    z = zlib.decompressobj(31)
    try:
        z.decompress(data)
    except zlib.error:
        return False
    return len(data) == n and z.eof and not z.unused_data


def first_block(f: pa.NativeFile, start: int, end: int) -> int | None:
    """The place in start:end where a block begins; to tell it from bytes that look like a header, the block is inflated."""
    size = f.size()
    span = f.read_at(min(end - start + _HEAD, size - start, _BLOCK + 2 * _HEAD + 4), start)
    while True:
        at = span.find(b"\x1f\x8b\x08\x04")
        while 0 <= at and start + at < end:
            n = block_size(span[at : at + _HEAD]) if at + _HEAD <= len(span) else block_size(f.read_at(_HEAD, start + at))
            if n and _is_block(f.read_at(n, start + at), n):
                return start + at
            at = span.find(b"\x1f\x8b\x08\x04", at + 1)
        start += max(1, len(span) - 3)
        if start >= end:
            return None
        span = f.read_at(min(end - start + _HEAD, size - start, READ_BYTES), start)


def blocks_from(f: pa.NativeFile, at: int) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the blocks from one on to the end of the file."""
    size, held, base = f.size(), b"", at
    while at < size:
        if at + _BLOCK > base + len(held):
            base, held = at, f.read_at(READ_BYTES, at)
        n = block_size(held[at - base : at - base + _HEAD])
        if not n:
            raise ValueError(f"no block of gzip at byte {at}")
        yield at, zlib.decompress(held[at - base : at - base + n], 31)
        at += n


def block_lines(f: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin in the blocks which begin in start:end; a line at the very start of a block after the first is the range's before."""
    at = 0 if start == 0 else first_block(f, start, end)
    if at is None:
        return
    held, skip = [], start > 0
    for place, content in blocks_from(f, at):
        if place >= end and skip:
            return  # the line it started in ends later: none begins here
        *whole, rest = content.split(b"\n")
        for line in whole:
            held.append(line)
            if not skip:
                yield b"".join(held)
            held, skip = [], False
            if place >= end:
                return
        held.append(rest)
    if not skip and any(held):
        yield b"".join(held)


def chunk_lines(f: pa.NativeFile, chunk: tuple[int, int]) -> Iterator[bytes]:
    """The lines that begin in a stretch of virtual offsets, at the start of which one begins."""
    (start, end), tail = chunk, []
    for place, content in blocks_from(f, start >> 16):
        here = (start & 0xFFFF) if place == start >> 16 else 0
        for line in content[here:].split(b"\n"):
            if not tail and place << 16 | here >= end:
                return
            tail.append(line)
            here += len(line) + 1
            if here <= len(content):
                yield b"".join(tail)
                tail = []
        tail = tail if any(tail) else []
    if tail:
        yield b"".join(tail)


def stream_lines(f: pa.NativeFile) -> Iterator[bytes]:
    """The lines of gzip of one or more members, inflated as it is read."""
    z, tail, fresh = zlib.decompressobj(31), [], True
    while got := f.read(READ_BYTES):
        while got:
            if z.eof:
                z, fresh = zlib.decompressobj(31), True
            content = z.decompress(got)
            got, fresh = z.unused_data if z.eof else b"", False
            *whole, rest = content.split(b"\n")
            for line in whole:
                tail.append(line)
                yield b"".join(tail)
                tail = []
            tail.append(rest)
    if not z.eof and not fresh:
        raise EOFError("the gzip file ends within a member")
    if any(tail):
        yield b"".join(tail)


class BlockGzipLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "block_gzip_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        chunks = self.options.get("chunks")
        return _BlockGzipReader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)), None if chunks is None else json.loads(chunks))


class _BlockGzipReader(DataSourceReader):
    def __init__(self, path: str, each: int, chunks: list[tuple[int, int]] | None):
        self.path, self.each, self.chunks = path, each, chunks

    def partitions(self) -> list[Range]:
        if self.chunks is not None:
            return [Range(*c, first=-1) for c in self.chunks] or [Range(0, 0, first=-1)]
        with open_file(self.path) as f:
            size = f.size()
            return ranges_of(size, self.each) if block_size(f.read_at(_HEAD, 0)) else [Range(0, -1)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with open_file(self.path) as f:
            if partition.first < 0:
                lines = chunk_lines(f, (partition.start, partition.end)) if partition.end else iter(())
            else:
                lines = stream_lines(f) if partition.end < 0 else block_lines(f, partition.start, partition.end)
            held, size = [], 0
            for line in lines:
                held.append(line.decode())
                size += len(line)
                if len(held) >= BATCH_LINES or size >= 8 * READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])


def read_gzip_lines(spark: SparkSession, path: str, *, range_bytes: int = RANGE_BYTES, chunks: list[tuple[int, int]] | None = None) -> DataFrame:
    """(value): the lines of a gzip file, of blocks in many tasks; chunks: those that begin in these stretches of virtual offsets."""
    spark.dataSource.register(BlockGzipLines)
    reader = spark.read.format("block_gzip_lines").option("rangeBytes", range_bytes)
    return (reader if chunks is None else reader.option("chunks", json.dumps(chunks))).load(path)


# PLINK

#: Copies of the first allele of the .bim line by the two bits of a cell; -1: not called.
_COPIES = np.array([2, -1, 1, 0])
_MAGIC = b"\x6c\x1b\x01"


def sample_fields(path: str) -> list[list[str]]:
    with open_file(path) as f:
        return [line.split() for line in f.read().decode().splitlines() if line.strip()]


def bim_ranges(spark: SparkSession, root: str, *, range_bytes: int = RANGE_BYTES) -> list[Range]:
    """Byte ranges of the .bim with the numbers of their lines, so many that a range has about `range_bytes` of the .bed; a row for each of them comes to the driver."""
    with open_file(f"{root}.bim") as f, open_file(f"{root}.bed") as g:
        size, n = f.size(), max(1, -(-g.size() // range_bytes), -(-f.size() // range_bytes))
    ranges = ranges_of(size, max(1, -(-size // n)))
    if not ranges:
        return []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open_file(f"{root}.bim") as f:
            for batch in batches:
                found = [sum(1 for line in lines_from(f, start, end) if line.strip()) for start, end in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["start", "n"])

    table = spark.createDataFrame([(r.start, r.end) for r in ranges], "start long, end long").repartition(min(len(ranges), 10_000))
    counts = {r["start"]: r["n"] for r in table.mapInArrow(count, "start long, n long").collect()}
    first, out = 0, []
    for r in ranges:
        if counts[r.start]:
            out.append(Range(r.start, r.end, first, counts[r.start]))
            first += counts[r.start]
    return out


class PlinkCells(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plink_cells"

    def schema(self) -> str:
        return "contig string, position int, alleles array<string>, s string, gt array<int>, n_alt int"

    def reader(self, schema) -> DataSourceReader:
        return _PlinkReader(self.options["path"], [Range(*r) for r in json.loads(self.options["ranges"])])


class _PlinkReader(DataSourceReader):
    def __init__(self, root: str, ranges: list[Range]):
        self.root, self.ranges = root, ranges

    def partitions(self) -> list[Range]:
        return self.ranges or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        samples = pa.array([x[1] for x in sample_fields(f"{self.root}.fam")], pa.string())
        width, n = -(-len(samples) // 4), len(samples)
        rows = max(1, BATCH_CELLS // max(1, n))
        with open_file(f"{self.root}.bim") as bim, open_file(f"{self.root}.bed") as bed:
            variants = [line.split() for line in lines_from(bim, partition.start, partition.end) if line.strip()]
            for lo in range(0, len(variants), rows):
                part = variants[lo : lo + rows]
                content = bed.read_at(len(part) * width, len(_MAGIC) + (partition.first + lo) * width)
                bits = (np.frombuffer(content, np.uint8).reshape(len(part), width)[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
                value = _COPIES[bits.reshape(len(part), 4 * width)[:, :n]].ravel()
                of = pa.array(np.repeat(np.arange(len(part)), n))
                alleles = pa.array([[x[5].decode(), x[4].decode()] for x in part], pa.list_(pa.string()))
                called = value >= 0
                first, second = np.where(value == 2, 1, 0), np.where(value >= 1, 1, 0)
                pairs = pa.array(np.stack([first, second], 1)[called].ravel(), pa.int32())
                at = pa.array(np.concatenate(([0], np.cumsum(2 * called))), pa.int32(), mask=np.concatenate((~called, [False])))
                columns = [pa.array([x[0].decode() for x in part]).take(of), pa.array([int(x[3]) for x in part], pa.int32()).take(of), alleles.take(of), samples.take(pa.array(np.tile(np.arange(n), len(part)))), pa.ListArray.from_arrays(at, pairs), pa.array(value, pa.int32(), mask=~called)]
                yield pa.RecordBatch.from_arrays(columns, ["contig", "position", "alleles", "s", "gt", "n_alt"])


def read_plink_cells(spark: SparkSession, root: str, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every cell of a PLINK file set. The second allele of the .bim is the reference; 00 is homozygous for the first, 01 not called."""
    ranges = bim_ranges(spark, root, range_bytes=range_bytes)
    rows, width = sum(r.rows for r in ranges), -(-len(sample_fields(f"{root}.fam")) // 4)
    with open_file(f"{root}.bed") as f:
        if f.read_at(3, 0) != _MAGIC:
            raise ValueError(f"{root}.bed is no .bed file with variants as rows")
        if f.size() != len(_MAGIC) + rows * width:
            raise ValueError(f"{root}.bed has {f.size()} bytes, not those of {rows} variants and the samples of {root}.fam")
    spark.dataSource.register(PlinkCells)
    return spark.read.format("plink_cells").option("ranges", json.dumps([(r.start, r.end, r.first, r.rows) for r in ranges])).load(root)
