"""Sharding: size-tiered compaction of small immutable shards under a versioned manifest.

Arrivals are appended as small shards of consecutive ids and never changed.
Shards of similar size form a tier - tier t holds those of `base` * `factor`^t
bytes and more - and a tier with at least `fan_in` shards below the target size
is merged: its shards, in order, are cut into runs of `target` bytes. The plan
works on the shards' sizes alone, over and over until no tier is due; then
each run is written once, by one task, to a new file. The state is a manifest:
version n+1 is written aside and renamed into place, which fails if that
version exists, so a commit happens wholly or not at all and readers of version
n keep their files. Every attempt writes to a folder of its own: what a crashed
one left is read by nobody, hinders no later one and goes with `clean`. Sizes
are bytes of text, so a plan does not depend on the file format.

A manifest has a row of some 100 bytes for each shard, which the driver reads
and plans by: 100 TB in shards of 64 MB are 1.6 million rows. Larger corpora
take a larger target. Arrivals in the order of their ids make one file or two
a shard; from other orders each task writes one for every shard it touches.

Edge cases: null and empty texts have 0 bytes and stay; null ids are one shard
before the others of their arrival; negative ids and ids beyond 2^53 are
numbered exactly; repeated rows are all kept; a text larger than the target
makes a larger shard; no rows give a manifest without shards, which reads as an
empty table with the columns of the last append; a manifest that gives two
shards one number is refused; extra columns are kept as they are,
unless they clash with the shard's own (`shard`), which is an error.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from allelarium.llm.common import Scratch, _path, read_table

#: Ids of a shard of an arrival at most, shards of an arrival at least (so that it is written by several tasks), and bytes of text of a compacted shard.
ARRIVAL_IDS = 4_096
ARRIVAL_SHARDS = 8
TARGET_BYTES = 64 << 20
BASE_BYTES = 4 << 10
FACTOR = 4
FAN_IN = 4


@dataclass(frozen=True)
class Shard:
    """`number` orders shards by their arrival; the folder `folder`/shard=`key` has its files, which hold just this shard's rows."""

    number: int
    rows: int
    size: int
    folder: str
    key: int | None


def tier_of(size: int, *, base: int = BASE_BYTES, factor: int = FACTOR) -> int:
    tier = 0
    while size >= base * factor ** (tier + 1):
        tier += 1
    return tier


def plan_compaction(sizes: dict[int, int], *, target: int = TARGET_BYTES, fan_in: int = FAN_IN, base: int = BASE_BYTES, factor: int = FACTOR) -> dict[int, int]:
    """Shard number -> number of the merged shard (its first member); shards that stay map to themselves."""
    to, now = {n: n for n in sizes}, dict(sizes)
    while True:
        tiers: dict[int, list[int]] = {}
        for n in sorted(now):
            if now[n] < target:
                tiers.setdefault(tier_of(now[n], base=base, factor=factor), []).append(n)
        due = [t for t, members in tiers.items() if len(members) >= fan_in]
        if not due:
            return to
        merged, before, first, last_run = {}, 0, -1, -1
        for n in tiers[min(due)]:
            if (run := before // target) != last_run:
                first, last_run = n, run
            merged[n] = first
            before += now[n]
        if all(n == m for n, m in merged.items()):
            return to
        for n, m in merged.items():
            if n != m:
                now[m] += now.pop(n)
        to = {n: merged.get(m, m) for n, m in to.items()}


class ShardStore:
    """Shards of one dataset below `root`, on any file system that Spark writes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> int:
        """The last committed version; 0 before any."""
        fs, path = _path(self.spark, f"{self.root}/manifests")
        if not fs.exists(path):
            return 0
        return max((int(f.getPath().getName().removesuffix(".json")) for f in fs.listStatus(path) if f.getPath().getName().endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> list[Shard]:
        return [Shard(**x) for x in self._state(version).get("shards", [])]

    def _state(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {}
        fs, path = _path(self.spark, f"{self.root}/manifests/{version:08d}.json")
        stream = fs.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text)

    def commit(self, shards: list[Shard], read_version: int, schema: dict | None = None) -> int:
        """Make `shards` the version after `read_version`; raises if another writer has committed it. `schema` is that of the rows, by default as it was."""
        version = read_version + 1
        if len({s.number for s in shards}) < len(shards):
            raise ValueError("two shards have one number")
        schema = schema or self._state(read_version).get("schema")
        text = json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in sorted(shards, key=lambda s: s.number)]})
        fs, aside = _path(self.spark, f"{self.root}/manifests/.{version:08d}.{uuid.uuid4().hex}")
        _, place = _path(self.spark, f"{self.root}/manifests/{version:08d}.json")
        stream = fs.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context, sc = self.spark.sparkContext._jvm.org.apache.hadoop.fs, self.spark.sparkContext
        rename = getattr(context, "Options$Rename")
        options = sc._gateway.new_array(rename, 1)
        options[0] = rename.NONE  # never over an existing file
        try:
            context.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), fs.makeQualified(place), options)
        except Py4JJavaError as e:
            fs.delete(aside, False)
            if fs.exists(place):
                raise FileExistsError(f"version {version} is already committed") from e
            raise
        return version

    def _folder(self, kind: str, version: int) -> str:
        return f"{kind}-{version:08d}-{uuid.uuid4().hex[:12]}"

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows.write.mode("error").option("compression", "zstd").partitionBy("shard").parquet(f"{self.root}/{folder}")

    def append(self, docs: DataFrame, *, arrival_ids: int | None = None) -> int:
        """Write an arrival as immutable shards of `arrival_ids` consecutive ids and commit them; the new version. By default of ARRIVAL_IDS ids, or fewer where the span of the ids gives fewer than ARRIVAL_SHARDS shards."""
        if "shard" in docs.columns:
            raise ValueError("the rows have a column named shard")
        if arrival_ids is None:
            lo, hi = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
            arrival_ids = ARRIVAL_IDS if lo is None else max(1, min(ARRIVAL_IDS, (hi - lo + 1) // ARRIVAL_SHARDS))
        read = self.version()
        known = self.manifest(read)
        first = max((s.number for s in known), default=-1) + 1
        # floor division of longs: `div` cuts towards zero
        key = F.expr(f"cast(doc_id as long) div {arrival_ids} - case when cast(doc_id as long) % {arrival_ids} < 0 then 1 else 0 end")
        folder = self._folder("arrivals", read + 1)
        self._write(docs.withColumn("shard", key), folder)
        sizes = self._keyed(folder).groupBy("shard").agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size"))
        found = sorted(((r["shard"] is not None, r["shard"] or 0, r) for r in sizes.collect()), key=lambda x: x[:2])
        new = [Shard(first + i, r["rows"], r["size"], folder, r["shard"]) for i, (_, _, r) in enumerate(found)]
        return self.commit(known + new, read, docs.schema.jsonValue())

    def compact(self, *, target: int = TARGET_BYTES, fan_in: int = FAN_IN, base: int = BASE_BYTES, factor: int = FACTOR) -> int:
        """Merge the tiers that are due and commit; the version, unchanged where none is due."""
        read = self.version()
        known = {s.number: s for s in self.manifest(read)}
        plan = plan_compaction({n: s.size for n, s in known.items()}, target=target, fan_in=fan_in, base=base, factor=factor)
        groups: dict[int, list[int]] = {}
        for n, m in plan.items():
            groups.setdefault(m, []).append(n)
        moves = {n: m for m, members in groups.items() if len(members) > 1 for n in members}
        if not moves:
            return read
        folder = self._folder("compacted", read + 1)
        rows = self._read([known[n] for n in moves], moves)
        targets = sorted(set(moves.values()))
        self._write(rows.repartitionByRange(len(targets), "shard"), folder)
        merged = [Shard(m, sum(known[n].rows for n in groups[m]), sum(known[n].size for n in groups[m]), folder, m) for m in targets]
        return self.commit([s for n, s in known.items() if n not in moves] + merged, read)

    def _keyed(self, folder: str, keys: list[int | None] | None = None) -> DataFrame:
        """The rows of a folder, or of its shards with the keys; `shard` is the key."""
        root = f"{self.root}/{folder}"
        name = lambda k: "__HIVE_DEFAULT_PARTITION__" if k is None else k
        paths = [root] if keys is None else [f"{root}/shard={name(k)}" for k in keys]
        fs, path = _path(self.spark, root)
        if not any(f.isDirectory() for f in fs.listStatus(path)):  # no rows, so no shard
            return self.spark.createDataFrame([], "doc_id long, text string, shard long")
        found = self.spark.read.option("basePath", root).parquet(*paths)
        return found.withColumn("shard", F.col("shard").cast("long"))

    def _read(self, shards: list[Shard], numbers: dict[int, int] | None = None) -> DataFrame:
        """The rows of shards; `shard` is the number, or what `numbers` gives for it."""
        parts = []
        for folder in sorted({s.folder for s in shards}):
            here = [s for s in shards if s.folder == folder]
            rows = self._keyed(folder, [s.key for s in here])
            table = self.spark.createDataFrame([(s.key, (numbers or {}).get(s.number, s.number)) for s in here], "_key long, _number long")  # a row for each shard
            joined = rows.join(F.broadcast(table), rows["shard"].eqNullSafe(table["_key"]))
            parts.append(joined.select(*(rows[c] for c in rows.columns if c != "shard"), F.col("_number").alias("shard")))
        return reduce(DataFrame.unionByName, parts)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, with their `shard`; None before the first append."""
        state = self._state(version)
        if not state or not state["schema"]:
            return None
        shards = [Shard(**x) for x in state["shards"]]
        return self._read(shards) if shards else self.spark.createDataFrame([], StructType.fromJson(state["schema"]).add("shard", "long"))

    def clean(self, keep: int = 1) -> None:
        """Delete the files that none of the last `keep` versions refers to, those of crashed attempts included. Attempts at the next version stay."""
        last = self.version()
        live = {(s.folder, s.key) for v in range(max(1, last - keep + 1), last + 1) for s in self.manifest(v)}
        fs, root = _path(self.spark, self.root)
        for at in fs.listStatus(root) if fs.exists(root) else []:
            folder = at.getPath().getName()
            kind, _, rest = folder.partition("-")
            if kind not in ("arrivals", "compacted") or int(rest.split("-")[0]) > last:
                continue
            keys = {k for f, k in live if f == folder}
            if not keys:
                fs.delete(at.getPath(), True)
                continue
            for part in fs.listStatus(at.getPath()):
                key = part.getPath().getName().removeprefix("shard=")
                if part.isDirectory() and (None if key == "__HIVE_DEFAULT_PARTITION__" else int(key)) not in keys:
                    fs.delete(part.getPath(), True)


#: Sixteenths of the documents in each arrival of the query.
ARRIVALS = (1, 3, 12)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents appended in arrivals of unlike size, compacted after each, and read back.

    Per document: doc_id, shard, n_bytes, the version of the last append and that after its compaction, shard_rows, shard_bytes.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    store = ShardStore(spark, f"{Scratch(spark, 'shards').root}/documents")
    of, first = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % sum(ARRIVALS), 0
    for size in ARRIVALS:
        appended = store.append(docs.where(of.between(first, first + size - 1)))
        version = store.compact()
        first += size
    shards = spark.createDataFrame([(s.number, s.rows, s.size) for s in store.manifest(version)], "shard long, shard_rows long, shard_bytes long")  # a row for each shard
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = store.read(version).select("doc_id", "shard", n_bytes.alias("n_bytes"), F.lit(appended).cast("long").alias("appended_version"), F.lit(version).cast("long").alias("version"))
    return rows.join(F.broadcast(shards), "shard").select("doc_id", "shard", "n_bytes", "appended_version", "version", "shard_rows", "shard_bytes")


QUERIES = {"op4_sharding": op4_sharding}
SQL: dict[str, str] = {}
