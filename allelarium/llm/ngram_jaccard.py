"""N-gram Jaccard join by filters under several global token orders, as components of links.

A document's set holds the 64-bit hashes of its distinct n-word shingles. Two
documents link when 100 * intersection >= percent * union. Equal sets form a
class, and one class takes part once.

1. Every order of all tokens gives a prefix filter: two sets that link share a
   token among the first size - ceil(size * percent / 100) + 1 of each. The
   first order is the index: tokens that are frequent come last, the others in
   the order of a hash, so a passage that many documents share is in no prefix
   unless a document has little else. The further orders are other hashes.
2. An index list gives the pairs whose sizes and places in the two sets allow a
   link if its token is the first that they share. A list that has more of them
   than members has every set paired with one pivot instead. Pairs pass the
   filters of length and parity (a bitmap with a bit flipped by each token: the
   bits in which two differ are at most the tokens in which they differ), then
   must share a prefix token under each further order, for which the prefixes
   alone are read; whole sets are joined only for the pairs that are left, which
   are verified on them. Links make components.
3. Only lists with pivots that still hold several components are looked at again, for pairs
   across components that pass the filters: at first a few for each pair of
   components, then, with what is left apart, all. So a group of near copies of
   size m costs about m pairs and no link between components is missed.

Lists are cut into blocks where they are long: those outside the commonest
component are dealt into parts, each of which meets every other part and every
deal of that component in a block of its own, so a block holds about two parts
and no pair is compared twice. No list, link or
component is gathered on the driver; what is broadcast there has a bound: the
frequent tokens (at least the share `HEAVY_SHARE` of the documents has each) and
ids of at most `BROADCAST_IDS` documents to verify, beyond which these are
joined by shuffle.

Edge cases: a null or empty text, or one without words, has an empty set and
links with nothing; with fewer than n words the whole sequence is the one
token; repeated rows and equal ids are linked as equal sets or compared as
other documents; a null id stays and takes its component's id where that has
one; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelarium.llm.common import Scratch, Words, left_join_groups, mix64, read_table, shingle_hashes, text_slices

N, PERCENT = 4, 85
#: Tokens count as frequent from this share of the documents on, but not below HEAVY_LEAST documents.
HEAVY_SHARE, HEAVY_LEAST = 1e-3, 64
#: A task counts its tokens in pieces of so many, and reports those that a piece has so often.
PIECE, PIECE_LEAST = 2 << 20, 4
#: Prefix tokens of one index bucket; sets of one block of a list; ids that are broadcast at most.
BUCKET_ROWS, BLOCK_ROWS, BROADCAST_IDS = 500_000, 20_000, 1_000_000
#: Bits of a parity bitmap at least: small sets that just miss the threshold then rarely pass.
MIN_BITS = 1024
#: Sets of a list at most for its pairs to be looked at where it is made.
LIST_ROWS = 1024
#: Pairs that the first look across components takes for each pair of components in a list.
FEW = 4
_ORDERS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)]
#: `pos`: how many tokens of the set come before this one, at most 65,535.
_POST = np.dtype([("token", "<u8"), ("node", "<i8"), ("n", "<i4"), ("pos", "<u2"), ("heavy", "u1")])


def prefix_length(n: int, percent: int) -> int:
    return n + percent * -n // 100 + 1


def max_difference(total: np.ndarray | int, percent: int):
    """Tokens in which two sets of `total` tokens together may differ and still link."""
    return total * (100 - percent) // (100 + percent)


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """For each text its class (a hash of the set; None for an empty one) and the sorted set."""
    words = Words(column)
    for i in range(len(words)):
        tokens = np.unique(shingle_hashes(words.of(i), n))
        yield (xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63) if len(tokens) else None), tokens


def parity_bitmap(tokens: np.ndarray) -> bytes:
    """From half a bit to one bit a token: sets without a common token differ in half of the bits, a quarter of n at least; those that link at 80 percent in 0.23 n at most."""
    bits = min(1 << 16, max(MIN_BITS, 1 << (len(tokens) - 1).bit_length() >> 1))
    return np.packbits((np.bincount((mix64(tokens ^ np.uint64(1)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(bitmap: bytes, size: int) -> np.ndarray:
    b = np.frombuffer(bitmap, np.uint8)
    while len(b) > size:
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return b.view(np.uint64)


def _may_link(na: int, nb: int, percent: int) -> bool:
    return 100 * min(na, nb) >= percent * max(na, nb)


def _nodes(n: int):
    """Rows: a document each (kind 0), or a token that a piece of the task has often (kind 1; node: token, n: count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(ids, nodes, sizes, maps, kind):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary()), pa.array([kind] * len(ids), pa.int32())], ["doc_id", "node", "n", "bitmap", "kind"])

        def heavy():
            token, count = np.unique(np.concatenate(piece), return_counts=True)
            often = count >= PIECE_LEAST
            return rows([None] * int(often.sum()), token[often].view(np.int64), count[often], [None] * int(often.sum()), 1)

        piece, held, seen = [], 0, set()
        for batch in batches:
            for part in text_slices(batch, 1):
                nodes, sizes, maps = [], [], []
                for node, tokens in _sets(part.column(1), n):
                    new = node is not None and node not in seen
                    nodes.append(node)
                    sizes.append(len(tokens))
                    maps.append(parity_bitmap(tokens) if new else None)
                    if new:
                        seen.add(node)
                        piece.append(tokens)
                        held += len(tokens)
                yield rows(part.column(0), nodes, sizes, maps, 0)
                if held >= PIECE:
                    yield heavy()
                    piece, held, seen = [], 0, set()
        if piece:
            yield heavy()

    return run


def _postings(n: int, percent: int, frequent: np.ndarray, buckets: int):
    """Packed prefix tokens of each class under the first order, by bucket; those of frequent tokens are dealt over all buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed():
            post = np.concatenate(held)
            at = np.where(post["heavy"] == 1, post["node"].view(np.uint64), post["token"]) % np.uint64(buckets)
            order = np.argsort(at, kind="stable")
            post, at = post[order], at[order]
            edges = np.flatnonzero(np.diff(at)) + 1
            return pa.RecordBatch.from_arrays([pa.array(at[np.concatenate(([0], edges))].astype(np.int32)), pa.array([p.tobytes() for p in np.split(post, edges)], pa.binary())], ["bucket", "post"])

        held, count, seen = [], 0, set()
        for batch in batches:
            for part in text_slices(batch, 1):
                for node, tokens in _sets(part.column(1), n):
                    if node is None or node in seen:
                        continue
                    seen.add(node)
                    key = mix64(tokens ^ _ORDERS[0])
                    heavy = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens if len(frequent) else np.zeros(len(tokens), bool)
                    first = np.lexsort((key, heavy))[: prefix_length(len(tokens), percent)]
                    post = np.empty(len(first), _POST)
                    post["token"], post["node"], post["n"], post["heavy"] = key[first], node, len(tokens), heavy[first]
                    post["pos"] = np.minimum(np.arange(len(first)), 65_535)
                    held.append(post)
                    count += len(post)
            if count >= 1 << 20:
                yield packed()
                held, count, seen = [], 0, set()
        if held:
            yield packed()

    return run


def _first_shared(post: np.ndarray, members: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (two arrays) that may link if the token of their list is the first they share; and for each list whether it has more of them than members, so that they are not all here.

    `post` is sorted by token, then n. From its first shared token on a set has n - pos tokens, and no pair shares more. A pair
    dropped in one list is met again in the list of its first token, so none that links is lost.
    """
    ends, members_of = np.repeat(np.cumsum(members), members), np.repeat(np.arange(len(members)), members)
    n = post["n"].astype(np.int64)
    most = (100 + percent) * (n - post["pos"])
    full = (members > LIST_ROWS) | (np.maximum.reduceat(post["heavy"], np.cumsum(members) - members) == 1 if len(post) else np.zeros(0, bool))
    found, a, b, lag = np.zeros(len(members), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    at = np.arange(len(post))
    while len(at):
        lag += 1
        at = at[~full[members_of[at]] & (at + lag < ends[at])]
        at = at[most[at] >= percent * (n[at] + n[at + lag])]  # sizes grow with the lag: what fails here fails from here on
        near = at[most[at + lag] >= percent * (n[at] + n[at + lag])]
        a.append(near)
        b.append(near + lag)
        np.add.at(found, members_of[near], 1)
        full |= found > members
    a, b = np.concatenate(a), np.concatenate(b)
    kept = ~full[members_of[a]]
    return a[kept], b[kept], full


def _lists(percent: int):
    """Of one bucket the lists with many pairs that may link: token, node, n, heavy, members, pivot, pivot_n; of other lists these pairs alone, as node and pivot without a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post = np.frombuffer(b"".join(x.as_py() for batch in batches for x in batch.column("post")), _POST)
        post = post[np.lexsort((post["node"], post["token"]))]
        same = np.zeros(len(post), bool)
        same[1:] = (post["token"][1:] == post["token"][:-1]) & (post["node"][1:] == post["node"][:-1])
        post = post[~same]
        starts = np.flatnonzero(np.concatenate(([True], post["token"][1:] != post["token"][:-1])))
        members = np.diff(np.append(starts, len(post)))
        keep = (members > 1) | (post["heavy"][starts] == 1)
        pivot = post[starts[keep]]
        post, members = post[np.repeat(keep, members)], members[keep]
        by_size = np.lexsort((post["n"], post["token"]))
        a, b, full = _first_shared(post[by_size], members, percent)
        nodes = np.stack([post["node"][by_size[a]], post["node"][by_size[b]], post["n"][by_size[a]], post["n"][by_size[b]]])
        nodes = np.where(nodes[0] < nodes[1], nodes, nodes[[1, 0, 3, 2]])
        nodes = nodes[:, np.lexsort(nodes[:2])]
        x, y, nx, ny = nodes[:, np.append(True, (nodes[:2, 1:] != nodes[:2, :-1]).any(0))[: nodes.shape[1]]]
        rows = np.repeat(full, members)
        out, pivot, many = post[rows], np.repeat(pivot, members)[rows], np.repeat(members, members)[rows]
        token = pa.concat_arrays([pa.array(np.ascontiguousarray(out["token"]).view(np.int64)), pa.nulls(len(x), pa.int64())])
        both = lambda of_lists, of_pairs: pa.array(np.concatenate([of_lists.astype(np.int64), of_pairs]))
        two = np.full(len(x), 2)
        columns = [token, both(out["node"], x), both(out["n"], nx), both(out["heavy"], 0 * two), both(many, two), both(pivot["node"], y), both(pivot["n"], ny)]
        yield pa.RecordBatch.from_arrays(columns, ["token", "node", "n", "heavy", "members", "pivot", "pivot_n"])

    return run


def _pass_parity(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, ma, mb = (batch.column(i).to_pylist() for i in range(6))
            keep = []
            for i in range(len(a)):
                size = min(len(ma[i]), len(mb[i]))
                if _may_link(na[i], nb[i], percent) and int(np.bitwise_count(_folded(ma[i], size) ^ _folded(mb[i], size)).sum()) <= max_difference(na[i] + nb[i], percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    return run


def further_prefixes(tokens: np.ndarray, percent: int) -> list[bytes]:
    """A set's prefix under each further order, as the upper halves of its keys; equal halves of unlike tokens only let a pair pass."""
    p = prefix_length(len(tokens), percent)
    keys = (mix64(tokens ^ order) for order in _ORDERS[1:])
    return [np.unique(((np.partition(key, p - 1)[:p] if p < len(key) else key) >> np.uint64(32)).astype(np.uint32)).tobytes() for key in keys]


def _pass_orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that share a prefix token under every further order."""

    def share(x: list[bytes], y: list[bytes]) -> bool:
        return all(len(np.intersect1d(np.frombuffer(i, np.uint32), np.frombuffer(j, np.uint32), assume_unique=True)) for i, j in zip(x, y, strict=True))

    for batch in batches:
        keep = pa.array([i for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)) if share(x, y)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])


def _verify(percent: int):
    """Pairs of sets that link on their whole sets."""

    def links(x: np.ndarray, y: np.ndarray) -> bool:
        if not _may_link(len(x), len(y), percent):
            return False
        common = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * common >= percent * (len(x) + len(y) - common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)) if links(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    return run


def _across(percent: int, few: int | None):
    """Pairs of a block, across components, that pass the filters of length and parity; `few` for each pair of components. Sets of one side other than 0 do not meet."""

    def pairs(post: dict[str, np.ndarray], maps: list[bytes]) -> Iterator[tuple[int, int]]:
        comp, n, node, side = post["comp"], post["n"], post["node"], post["side"]
        if comp.min() == comp.max():
            return
        value, count = np.unique(comp, return_counts=True)
        common = value[count.argmax()]
        taken: dict[tuple[int, int], int] = {}
        sizes = np.fromiter(map(len, maps), np.int64, len(maps))
        for size in np.unique(sizes):  # sets of like sizes have bitmaps of one size or of a neighbouring one
            at = np.flatnonzero((sizes == size) | (sizes == 2 * size))
            bits = np.stack([_folded(maps[k], size) for k in at])
            for row, i in enumerate(at):
                if comp[i] == common:
                    continue
                other = (comp[at] != comp[i]) & ((comp[at] == common) | (at > i)) & ((sizes[at] == size) | (sizes[i] == size))
                other &= (side[at] == 0) | (side[at] != side[i])
                other &= 100 * np.minimum(n[at], n[i]) >= percent * np.maximum(n[at], n[i])
                near = np.flatnonzero(other)
                near = near[np.bitwise_count(bits[near] ^ bits[row]).sum(1) <= max_difference(n[at[near]] + n[i], percent)]
                for k in at[near]:
                    if few is not None:
                        key = (min(comp[i], comp[k]), max(comp[i], comp[k]))
                        taken[key] = taken.get(key, 0) + 1
                        if taken[key] > few:
                            continue
                    yield min(node[i], node[k]), max(node[i], node[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(held: pa.Table) -> pa.RecordBatch | None:
            names = ["token", "salt", "side", "node", "n", "comp"]
            post = {c: held[c].to_numpy() for c in names}
            maps = held["bitmap"].to_pylist()
            edges = np.flatnonzero((np.diff(post["token"]) != 0) | (np.diff(post["salt"]) != 0)) + 1
            found: set[tuple[int, int]] = set()
            for lo, hi in zip([0, *edges], [*edges, len(maps)], strict=True):
                found.update(pairs({c: post[c][lo:hi] for c in names}, maps[lo:hi]))
            return pa.RecordBatch.from_arrays([pa.array([int(a) for a, _ in found], pa.int64()), pa.array([int(b) for _, b in found], pa.int64())], ["a", "b"])

        rest: pa.Table | None = None
        for batch in batches:  # sorted by token and salt; the last list of a batch may go on in the next
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not len(table):
                continue
            token, salt = table["token"].to_numpy(), table["salt"].to_numpy()
            last = int(np.flatnonzero((token != token[-1]) | (salt != salt[-1]))[-1]) + 1 if ((token != token[-1]) | (salt != salt[-1])).any() else 0
            if last:
                yield of(table.slice(0, last))
            rest = table.slice(last)
        if rest is not None and len(rest):
            yield of(rest)

    return run


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp): each linked node and a name of its component, by rounds of contraction along the least hashed neighbour."""
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("v"))
    edges = scratch.write(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), f"{name}-edges-0")
    nodes = scratch.write(edges.select("u").union(edges.select("v")).distinct().select(F.col("u").alias("node"), F.col("u").alias("comp")), f"{name}-map-0")
    step = 0
    while edges.take(1):
        step += 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(order(F.col("v"))).alias("least"))
        least = least.select("u", F.when(F.col("least") < order(F.col("u")), F.col("least.v")).otherwise(F.col("u")).alias("to"))
        least = scratch.write(least, f"{name}-least-{step}")
        moved = nodes.join(least, nodes["comp"] == least["u"], "left").select("node", F.coalesce("to", "comp").alias("comp"))
        nodes = scratch.write(moved, f"{name}-map-{step}")
        a = edges.join(least, "u").select(F.col("to").alias("x"), "v")
        b = a.join(least, a["v"] == least["u"]).select("x", F.col("to").alias("y"))
        edges = scratch.write(b.where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), f"{name}-edges-{step}")
        scratch.drop(f"{name}-edges-{step - 1}", f"{name}-map-{step - 1}", f"{name}-least-{step}")
    return nodes


def jaccard_components(docs: DataFrame, *, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs; links inside a component are not all enumerated."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-jaccard")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = scratch.write(texts.mapInArrow(_nodes(n), "doc_id long, node long, n long, bitmap binary, kind int"), "nodes")
    rows = found.where("kind = 0").select("doc_id", "node", "n")
    classes = found.where("kind = 0 and node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("bitmap").alias("bitmap"), F.count("*").alias("copies"))
    classes = scratch.write(classes, "classes")
    total, tokens = rows.count(), classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    heavy = found.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= max(HEAVY_LEAST, HEAVY_SHARE * total)).select("node")
    frequent = np.sort(np.array([r[0] for r in heavy.toLocalIterator()], np.int64).view(np.uint64))  # at most the mean set's size / HEAVY_SHARE

    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(tokens) // BUCKET_ROWS))
    post = texts.mapInArrow(_postings(n, percent, frequent, buckets), "bucket int, post binary")
    lists = post.groupBy("bucket").applyInArrow(_grouped(_lists(percent)), "token long, node long, n long, heavy long, members long, pivot long, pivot_n long")
    lists = scratch.write(lists, "lists")

    may = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    star = lists.where("node <> pivot").where(may(F.col("n"), F.col("pivot_n"))).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    # the pivots of a frequent token's buckets, with the least of them
    tops = lists.where("heavy = 1").select("token", "pivot").distinct()
    least = tops.groupBy("token").agg(F.min("pivot").alias("top")).withColumnRenamed("token", "_token")
    tops = tops.join(least, tops["token"] == least["_token"]).where("pivot <> top").select(F.least("pivot", "top").alias("a"), F.greatest("pivot", "top").alias("b"))
    side = lambda s: classes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("bitmap").alias(f"m{s}"))
    pairs = star.union(tops).distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ma", "mb")
    pairs = scratch.write(pairs.mapInArrow(_pass_parity(percent), "a long, b long"), "pairs-star")
    links = _verified(pairs, texts, classes, n, percent, scratch, "star")
    comps = components(links, scratch, "star")

    for name, few in (("few", FEW), ("all", None)):
        at = lists.where("token is not null").join(comps, "node", "left").select("token", "node", "n", F.coalesce("comp", "node").alias("comp"))
        mixed = at.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi")
        mixed = scratch.write(mixed.select(F.col("token").alias("_token"), F.ceil(F.col("size") / BLOCK_ROWS).cast("int").alias("blocks")), f"mixed-{name}")
        long = mixed.where("blocks > 1")
        at = at.join(mixed.where("blocks = 1"), at["token"] == mixed["_token"], "left_semi").select("*", F.lit(0).cast("long").alias("salt"), F.lit(0).alias("side")).unionByName(_dealt(at, long))
        at = at.join(classes.select("node", "bitmap"), "node").select("token", "salt", "side", "node", "n", "comp", "bitmap")
        at = at.repartition("token", "salt").sortWithinPartitions("token", "salt", "node")
        pairs = scratch.write(at.mapInArrow(_across(percent, few), "a long, b long").distinct(), f"pairs-{name}")
        if not pairs.take(1):
            break
        more = _verified(pairs, texts, classes, n, percent, scratch, name)
        if more.take(1):
            links = links.union(more).distinct()
            comps = components(links, scratch, name)

    member = classes.select("node", "doc_id", "copies").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of = member.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("sets"), F.sum("copies").alias("docs")).where("docs > 1")
    named = member.join(of, "comp").select("node", "component_id", F.col("copies").alias("n"))
    named = scratch.write(named, "named")
    scratch.drop("lists")
    out = left_join_groups(rows.withColumnRenamed("n", "n_shingles"), named, "node", total)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs, with their columns, that have their component's least doc_id, and those with a null id.

    Of rows with one id (or none) and one text a single one stays; different
    texts of one id stay or go together.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    found = scratch.write(jaccard_components(docs, **parameters).select("doc_id", "component_id"), "components")
    bounded = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    gone = bounded(scratch.write(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone"))
    several = bounded(scratch.write(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_several"), F.lit(True).alias("_is_several")), "several"))
    left = docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
    if not several.take(1):
        return left
    marked = left.join(several, left["doc_id"].cast("long").eqNullSafe(several["_several"]), "left")
    once = marked.where("_is_several").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return marked.where("_is_several is null").select(docs.columns).unionByName(once)


def _grouped(f):
    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(f(iter(table.to_batches()))))

    return run


def _dealt(at: DataFrame, long: DataFrame) -> DataFrame:
    """Lists longer than a block, in blocks (salt) of two sides: part with part, or part with a deal of the commonest component; side 0 meets itself."""
    here = at.join(F.broadcast(long), at["token"] == long["_token"]).drop("_token")  # at most rows / BLOCK_ROWS lists
    sizes = here.groupBy("token", "comp").agg(F.count("*").alias("size")).groupBy("token")
    sizes = sizes.agg(F.max_by("comp", F.struct("size", "comp")).alias("common"), F.max("size").alias("most"), F.sum("size").alias("size"))
    blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("long")
    sizes = sizes.select("token", "common", blocks(F.col("size") - F.col("most")).alias("parts"), blocks(F.col("most")).alias("deals"))
    here = here.join(F.broadcast(sizes), "token")
    parts, deals = F.col("parts"), F.col("deals")
    part, deal = F.pmod(F.xxhash64("node"), parts), F.pmod(F.xxhash64("node"), deals)
    each = lambda n, salt, side: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: F.struct(salt(k).alias("salt"), side(k).alias("side")))
    with_parts = each(parts, lambda q: F.least(part, q) * parts + F.greatest(part, q), lambda q: F.when(part == q, 0).when(part < q, 1).otherwise(2))
    with_deals = each(deals, lambda d: parts * parts + part * deals + d, lambda d: F.lit(1))
    as_deal = each(parts, lambda p: parts * parts + p * deals + deal, lambda p: F.lit(2))
    placed = F.when(F.col("comp") == F.col("common"), as_deal).otherwise(F.concat(with_parts, with_deals))
    return here.select("token", "node", "n", "comp", F.explode(placed).alias("at")).select("token", "node", "n", "comp", "at.salt", "at.side")


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, n: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of classes that link. Sets are made again from the texts of one document of each class."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    needed = scratch.write(needed.join(classes, "node").select("node", "doc_id"), f"needed-{name}")
    ids, nodes = needed.select(F.col("doc_id").alias("_id")).distinct(), needed.select(F.col("node").alias("_node"))
    bounded = F.broadcast if needed.count() <= BROADCAST_IDS else lambda keys: keys

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in text_slices(batch, 1):
                new = {node: t for node, t in _sets(part.column(1), n) if node is not None and node not in seen}
                seen.update(new)
                prefixes = pa.array([further_prefixes(t, percent) for t in new.values()], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), prefixes, pa.array([t.tobytes() for t in new.values()], pa.binary())], ["node", "prefixes", "tokens"])

    made = texts.join(bounded(ids), texts["doc_id"].eqNullSafe(ids["_id"]), "left_semi").mapInArrow(sets, "node long, prefixes array<binary>, tokens binary").withColumn("part", F.spark_partition_id())
    made = scratch.write(made.join(bounded(nodes), made["node"] == nodes["_node"], "left_semi"), f"sets-{name}")
    # rows of one id and text may lie in several tasks: the sets of one are kept, chosen without moving any
    again = made.groupBy("node").agg(F.min("part").alias("_part"), F.count("*").alias("times")).where("times > 1").select(F.col("node").alias("_node"), "_part")
    again = scratch.write(again, f"again-{name}")
    if again.take(1):
        made = made.join(again, (made["node"] == again["_node"]) & (made["part"] != again["_part"]), "left_anti")
    side = lambda s, c: made.select(F.col("node").alias(s), F.col(c).alias(f"{c}_{s}"))
    with_both = lambda pairs, c: pairs.join(side("a", c), "a").join(side("b", c), "b").select("a", "b", f"{c}_a", f"{c}_b")
    left = scratch.write(with_both(pairs, "prefixes").mapInArrow(_pass_orders, "a long, b long"), f"filtered-{name}")
    both = with_both(left, "tokens")
    links = scratch.write(both.mapInArrow(_verify(percent), "a long, b long"), f"links-{name}")
    links.count()
    scratch.drop(f"sets-{name}", f"again-{name}", f"needed-{name}", f"filtered-{name}")
    return links


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    return jaccard_components(read_table(spark, sf_dir, "documents"))


QUERIES = {"op1_ngram_jaccard_join": op1_ngram_jaccard_join}
SQL = {
    "op1_ngram_jaccard_join": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i : i + {N} - 1], ' ')) END) AS gram FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS other FROM sym UNION SELECT r.doc_id, e.b FROM reach r JOIN sym e ON e.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(least(d.doc_id, min(r.other)), d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id, s.n
"""
}
