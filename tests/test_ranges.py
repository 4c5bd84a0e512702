"""Files read by byte ranges, against the whole file, at many sizes of a range."""

import gzip
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from allelarium.sources import call_sets, ranges

EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def in_blocks(data: bytes, sizes) -> bytes:
    out, at = b"", 0
    while at < len(data):
        n = next(sizes)
        out += block(data[at : at + n])
        at += n
    return out + EOF_BLOCK


def contents(rng):
    yield b""
    yield b"\n"
    yield b"one line without an end"
    yield b"a\n\nb\n\n\n" * 40
    yield b"".join(b"%d\t%s\n" % (i, bytes(rng.choices(b"acgt\x1f\x8b\x08\x04", k=rng.choice([0, 3, 40, 900])))) for i in range(120))
    yield b"x" * 5_000 + b"\n" + b"short\n" * 30 + b"y" * 9_000 + b"\nlast"


def test_lines_of_ranges(tmp_path):
    rng = random.Random(4)
    for data in contents(rng):
        lines = data.split(b"\n")
        lines = lines if lines[-1] else lines[:-1]
        plain, packed = tmp_path / "p.txt", tmp_path / "p.bgz"
        plain.write_bytes(data)
        for sizes in (iter(lambda: 7, 0), iter(lambda: rng.randint(1, 300), 0), iter(lambda: 60_000, 0)):
            packed.write_bytes(in_blocks(data, sizes))
            for each in (1, 13, 64, 500, 10_000, 1 << 20):
                with ranges.open_file(str(plain)) as f:
                    assert [x for r in ranges.ranges_of(f.size(), each) for x in ranges.lines_from(f, r.start, r.end)] == lines
                with ranges.open_file(str(packed)) as f:
                    assert [x for r in ranges.ranges_of(f.size(), each) for x in ranges.block_lines(f, r.start, r.end)] == lines


def test_chance_headers_are_no_blocks(tmp_path):
    """Stored blocks whose content holds headers of blocks."""
    fake = block(b"fake")[:18]
    data = b"".join(fake + b"%d\n" % i for i in range(200))
    z = lambda d: b"\x01" + struct.pack("<HH", len(d), len(d) ^ 0xFFFF) + d
    stored = lambda d: b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(d) + 30) + z(d) + struct.pack("<II", zlib.crc32(d), len(d))
    path = tmp_path / "s.bgz"
    path.write_bytes(b"".join(stored(data[i : i + 700]) for i in range(0, len(data), 700)) + EOF_BLOCK)
    with ranges.open_file(f"file://{path}") as f:
        for each in (17, 333, 5_000):
            assert b"\n".join(x for r in ranges.ranges_of(f.size(), each) for x in ranges.block_lines(f, r.start, r.end)) + b"\n" == data


def test_gzip_frame(spark, tmp_path):
    lines = [f"{i}\té{'x' * (i % 50)}" for i in range(3_000)]
    data = ("\n".join(lines) + "\n").encode()
    (tmp_path / "b.gz").write_bytes(in_blocks(data, iter(lambda: 2_000, 0)))
    found = ranges.read_gzip_lines(spark, f"file://{tmp_path}/b.gz", range_bytes=1_000)
    assert found.rdd.getNumPartitions() > 5 and [r[0] for r in found.collect()] == lines
    (tmp_path / "m.gz").write_bytes(gzip.compress(data[:5_000]) + gzip.compress(b"") + gzip.compress(data[5_000:]))
    whole = ranges.read_gzip_lines(spark, f"{tmp_path}/m.gz", range_bytes=4_000)
    assert whole.rdd.getNumPartitions() == 1 and [r[0] for r in whole.collect()] == lines
    (tmp_path / "cut.gz").write_bytes(gzip.compress(data)[:-9])
    with pytest.raises(Exception, match="ends within a member"):
        ranges.read_gzip_lines(spark, f"{tmp_path}/cut.gz").count()


@pytest.mark.parametrize("n_samples,n_variants", [(1, 1), (4, 9), (7, 200), (5, 0)])
def test_plink_by_ranges(spark, tmp_path, n_samples, n_variants):
    rng = np.random.default_rng(n_variants)
    bits = rng.integers(0, 4, (n_variants, n_samples))
    width = -(-n_samples // 4)
    padded = np.zeros((n_variants, width * 4), np.uint8)
    padded[:, :n_samples] = bits
    packed = (padded.reshape(n_variants, width, 4) << np.array([0, 2, 4, 6])).sum(2).astype(np.uint8)
    root = f"{tmp_path}/x"
    open(f"{root}.bed", "wb").write(b"\x6c\x1b\x01" + packed.tobytes())
    open(f"{root}.bim", "w").write("".join(f"chr{1 + i % 3}\trs{'9' * (i % 17)}{i}\t0\t{10 + i}\tG\tA\n" for i in range(n_variants)))
    open(f"{root}.fam", "w").write("".join(f"f s{j} 0 0 1 -9\n" for j in range(n_samples)))
    copies = {0: 2, 1: None, 2: 1, 3: 0}
    gt = {None: None, 0: [0, 0], 1: [0, 1], 2: [1, 1]}
    want = sorted((10 + i, f"s{j}", f"chr{1 + i % 3}", copies[int(bits[i, j])]) for i in range(n_variants) for j in range(n_samples))
    for each in (3, 40, 1 << 20):
        cs = call_sets.read_plink(spark, f"file://{root}", range_bytes=each)
        got = cs.entries.collect()
        assert sorted((r["position"], r["s"], r["contig"], r["n_alt"]) for r in got) == want
        assert all(r["gt"] == gt[r["n_alt"]] and r["alleles"] == ["A", "G"] for r in got)
        assert cs.count() == (n_variants, n_samples) and "Exchange" not in cs.entries._jdf.queryExecution().toString()
        if n_variants == 200 and each == 3:
            assert cs.entries.rdd.getNumPartitions() > 100
    open(f"{root}.bed", "ab").write(b"\0")
    with pytest.raises(ValueError, match="not those of"):
        call_sets.read_plink(spark, root)


def test_lists_of_bytes_are_cut_once():
    assert ranges.block_size(EOF_BLOCK) == 28 and ranges.block_size(gzip.compress(b"x")) == 0
    assert [(r.start, r.end) for r in ranges.ranges_of(10, 4)] == [(0, 4), (4, 8), (8, 10)]
    assert isinstance(ranges.open_file(__file__), pa.NativeFile)
