"""One file written by many tasks: each writes its part, then the parts are put together without passing through the driver.

The rows' partitions, in order, are the parts. A task writes its bytes to a
file of its own beside the target and returns its name and size; an attempt
that fails leaves a file that nobody reads. With the sizes known, every part
has its place: on hdfs the file system itself concatenates the parts, in a
folder that all tasks share each task copies its part to its place in the
target, which can be repeated. Other stores have neither and take the parts
one after another from the driver, a piece at a time.

A part of text may be packed in gzip blocks (BGZF): blocks do not span parts,
so the concatenation is one valid file, and a task notes where its lines lie
for an index by position.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from allelarium.sources.files import _at
from allelarium.sources.ranges import READ_BYTES, locate, open_file

# Fixed values of the formats: bytes of text in a block, the empty block that ends a file, and the levels of an index.
BLOCK_TEXT, WINDOW_BITS, LEVELS = 0xFF00, 14, 5
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def gzip_block(text: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(text) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(text), len(text))


def bin_of(start: int, end: int) -> int:
    """The smallest bin of the index that holds start:end (zero-based, half open)."""
    for level in range(LEVELS, 0, -1):
        shift = WINDOW_BITS + 3 * (LEVELS - level)
        if start >> shift == (end - 1) >> shift:
            return ((1 << 3 * level) - 1) // 7 + (start >> shift)
    return 0


def bins_over(start: int, end: int) -> list[int]:
    """All bins that may hold something in start:end."""
    out = []
    for level in range(LEVELS + 1):
        shift, first = WINDOW_BITS + 3 * (LEVELS - level), ((1 << 3 * level) - 1) // 7
        out += range(first + (start >> shift), first + ((end - 1) >> shift) + 1)
    return out


@dataclass
class Places:
    """Where lines lie: for each contig the chunks of each bin and the least place of each window, in virtual offsets."""

    bins: dict[tuple[str, int], list[tuple[int, int]]] = field(default_factory=dict)
    windows: dict[tuple[str, int], int] = field(default_factory=dict)

    def add(self, contig: str, start: int, end: int, at: int, to: int) -> None:
        self.chunk(contig, bin_of(start, end), at, to)
        for w in range(start >> WINDOW_BITS, ((end - 1) >> WINDOW_BITS) + 1):
            self.windows.setdefault((contig, w), at)

    def chunk(self, contig: str, of: int, at: int, to: int) -> None:
        chunks = self.bins.setdefault((contig, of), [])
        if chunks and at >> 16 == chunks[-1][1] >> 16:  # in one block: read in one go
            chunks[-1] = (chunks[-1][0], to)
        else:
            chunks.append((at, to))


class _Packed:
    """Text to blocks; `place` is the virtual offset of the next byte."""

    def __init__(self, out):
        self.out, self.held, self.size = out, bytearray(), 0

    @property
    def place(self) -> int:
        return self.size << 16 | len(self.held)

    def write(self, text: bytes) -> None:
        self.held += text
        while len(self.held) >= BLOCK_TEXT:
            self._block(BLOCK_TEXT)

    def _block(self, n: int) -> None:
        data = gzip_block(bytes(self.held[:n]))
        self.out.write(data)
        self.size += len(data)
        del self.held[:n]

    def close(self) -> None:
        if self.held:
            self._block(len(self.held))


class _Plain:
    def __init__(self, out):
        self.out, self.size = out, 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        pass


_SCHEMA = "part int, file string, size long, contig string, bin int, at long, upto long"


def write_one_file(rows: DataFrame, path: str, *, header: bytes = b"", blocks: bool = False, encode: Callable[[pa.RecordBatch], Iterator[bytes]] | None = None, place: Callable[[bytes], tuple[str, int, int]] | None = None) -> Places:
    """The rows' bytes, partition after partition, as one file after `header`; blocks: packed in gzip blocks.

    `encode` gives the bytes of a batch, piece by piece; by default the first
    column's values, which are binary. `place` gives contig, start and end of a
    piece for the index that is returned.
    """
    encode = encode or (lambda batch: (x for x in batch.column(0).cast(pa.large_binary()).to_pylist()))
    fs, target = locate(path)
    parts = f"{target}.parts-{uuid.uuid4().hex[:12]}"
    fs.create_dir(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name, places = f"{parts}/{task.partitionId():06d}-{task.taskAttemptId()}", Places()
        with locate(path)[0].open_output_stream(name) as stream:
            out = _Packed(stream) if blocks else _Plain(stream)
            for batch in batches:
                for piece in encode(batch):
                    before = out.place if place else 0
                    out.write(piece)
                    if place:
                        places.add(*place(piece), before, out.place)
            out.close()
        found = [(task.partitionId(), name, out.size, None, None, 0, 0)]
        found += [(task.partitionId(), None, 0, c, b, at, to) for (c, b), chunks in places.bins.items() for at, to in chunks]
        found += [(task.partitionId(), None, 0, c, -1 - w, at, 0) for (c, w), at in places.windows.items()]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], ["part", "file", "size", "contig", "bin", "at", "upto"])

    # a row for each part, and for each bin and window that a part touches
    found = sorted(map(tuple, rows.mapInArrow(run, _SCHEMA).collect()), key=lambda r: (r[0], r[1] is None, r[5], r[4]))
    first, last = (gzip_block(header) if header else b"", END_BLOCK) if blocks else (header, b"")
    if len(header) > BLOCK_TEXT and blocks:
        first = b"".join(gzip_block(header[lo : lo + BLOCK_TEXT]) for lo in range(0, len(header), BLOCK_TEXT))
    start, at = {}, len(first)
    names = [(r[0], r[1], r[2]) for r in found if r[1]]
    for part, _, size in names:
        start[part] = at
        at += size
    _put_together(rows, path, first, [(name, start[part], size) for part, name, size in names if size], last, at)
    fs.delete_dir(parts)
    places = Places()
    for part, name, _, contig, of, lo, hi in found:
        if name:
            continue
        lo, hi = lo + (start[part] << 16), hi + (start[part] << 16)
        if of < 0:
            w = (contig, -1 - of)
            places.windows[w] = min(lo, places.windows.get(w, lo))
        else:
            places.chunk(contig, of, lo, hi)
    return places


def _put_together(rows: DataFrame, path: str, first: bytes, parts: list[tuple[str, int, int]], last: bytes, end: int) -> None:
    """The target of the head, the parts (name, place, size) and the tail; it appears under its name when it is whole."""
    spark = rows.sparkSession
    fs, target = locate(path)
    whole = f"{target}.whole-{uuid.uuid4().hex[:12]}"
    if isinstance(fs, pafs.LocalFileSystem):
        with open(whole, "wb") as f:
            f.write(first)
            f.truncate(end)
            f.seek(end)
            f.write(last)

        def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    with open(name, "rb") as part, open(whole, "r+b") as f:
                        f.seek(place)
                        while piece := part.read(READ_BYTES):
                            f.write(piece)
                yield pa.RecordBatch.from_arrays([batch.column(1)], ["place"])

        if parts:
            table = spark.createDataFrame([(name, place) for name, place, _ in parts], "name string, place long").repartition(min(len(parts), 1_000))
            table.mapInArrow(copy, "place long").collect()
    elif isinstance(fs, pafs.HadoopFileSystem):
        for name, data in ((whole, first), (f"{whole}-end", last)):
            with fs.open_output_stream(name) as f:
                f.write(data)
        hadoop, at = _at(spark, path)
        of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        names = [name for name, _, _ in parts] + ([f"{whole}-end"] if last else [])
        array = spark.sparkContext._gateway.new_array(of, len(names))
        for k, name in enumerate(names):
            array[k] = of(name)
        hadoop.concat(of(whole), array)
    else:
        with fs.open_output_stream(whole) as f:
            f.write(first)
            for name, _, _ in parts:
                with fs.open_input_stream(name) as part:
                    while piece := part.read(READ_BYTES):
                        f.write(piece)
            f.write(last)
    fs.move(whole, target)


def index_bytes(places: Places, contigs: list[str]) -> bytes:
    """The index by position of a file in gzip blocks whose lines have contig and position in their first two columns (TBI)."""
    names = b"".join(c.encode() + b"\0" for c in contigs)
    out = [b"TBI\1", struct.pack("<8i", len(contigs), 2, 1, 2, 0, ord("#"), 0, len(names)), names]
    for contig in contigs:
        bins = {b: chunks for (c, b), chunks in places.bins.items() if c == contig}
        out.append(struct.pack("<i", len(bins)))
        for b in sorted(bins):
            out.append(struct.pack("<Ii", b, len(bins[b])) + b"".join(struct.pack("<QQ", *chunk) for chunk in bins[b]))
        windows = {w: at for (c, w), at in places.windows.items() if c == contig}
        size, before = max(windows, default=-1) + 1, 0
        out.append(struct.pack("<i", size))
        for w in range(size):
            before = windows.get(w, before)
            out.append(struct.pack("<Q", before))
    data = b"".join(out)
    return b"".join(gzip_block(data[lo : lo + BLOCK_TEXT]) for lo in range(0, len(data), BLOCK_TEXT)) + END_BLOCK


def chunks_of(path: str, contig: str, start: int, end: int) -> list[tuple[int, int]]:
    """The stretches, in virtual offsets, in which an index has the lines that overlap start:end (zero-based, half open)."""
    with open_file(path) as f:
        packed, data = f.read(), b""
    while packed:
        z = zlib.decompressobj(31)
        data += z.decompress(packed)
        packed = z.unused_data
    if data[:4] != b"TBI\1":
        raise ValueError(f"{path} is no index")
    n, _, _, _, _, _, _, size = struct.unpack_from("<8i", data, 4)
    names, at = data[36 : 36 + size].split(b"\0")[:n], 36 + size
    wanted, out = set(bins_over(start, end)), []
    for name in names:
        mine, (count,), at = [], struct.unpack_from("<i", data, at), at + 4
        for _ in range(count):
            b, chunks = struct.unpack_from("<Ii", data, at)
            at += 8
            mine += [struct.unpack_from("<QQ", data, at + 16 * k) for k in range(chunks)] if b in wanted else []
            at += 16 * chunks
        (windows,) = struct.unpack_from("<i", data, at)
        least = struct.unpack_from("<Q", data, at + 4 + 8 * min(start >> WINDOW_BITS, windows - 1))[0] if windows else 0
        at += 4 + 8 * windows
        if name.decode() == contig:
            out = sorted((max(lo, least), hi) for lo, hi in mine if hi > least)
    merged: list[tuple[int, int]] = []
    for lo, hi in out:
        if merged and lo <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    return merged
