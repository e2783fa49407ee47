"""Classes of similar texts: MinHash bands give candidates, and every link is verified by Jaccard similarity.

A signature is cut into ``BANDS`` bands; texts that share a band's bucket are candidates. Other operators give
buckets of their own, and their own index of the texts that others are compared with. Copies of a text are
one node, and buckets of equal members are judged once. First each node is judged in its largest bucket only,
which joins most of a group of similar texts; then those buckets are judged whole whose members are still in
different classes. So no link within a bucket is lost, and what a group's many buckets have in common is not
compared again.

A group of at most ``FEW`` texts with at most ``LOAD`` shingles is judged in one task, which holds no more than
that. A larger one is never gathered: it is dealt to blocks. At first its members are compared with a few of
them, then those that are left over with more of the class that has formed. To judge a large bucket whole, some
members (the hubs) are each compared with all members of other classes, pair by pair. Hubs are taken from
outside the bucket's largest class; when all of those have been hubs, every pair of different classes has been
compared.

Nulls and texts without words have no shingles; their similarity to each other is 1, to others 0. Texts of
fewer words than a shingle are one shingle. Repeated rows are copies. An empty table has no classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.common import joined, sliced, written
from barloom.llm.graph import connected_components

BANDS, WIDTH = 25, 5
FEW, LOAD = 4_096, 2_000_000
#: Members that the others of a large group are compared with, by pass.
PASSES = (4, 16, 32)
#: Hubs of a large bucket in the first round and the factor by which they grow, up to the last number.
HUBS = (4, 4, 256)
#: Members of a large bucket that one task compares.
BLOCK_OF = 512

Judge = Callable[[list[str]], list[int]]


class Listed:
    """Sets by name. An index gives the names and sets that may be similar to a set: here all, in the order in which they came."""

    def __init__(self) -> None:
        self.sets: dict[int, np.ndarray] = {}

    def __contains__(self, name: int) -> bool:
        return name in self.sets

    def add(self, name: int, shingles: np.ndarray) -> None:
        self.sets[name] = shingles

    def near(self, shingles: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        yield from self.sets.items()


Index = Callable[[], Listed]


def buckets_of(fingerprint: Column) -> Column:
    """A 64-bit bucket for each band of a signature in hexadecimal digits, four a place."""
    return F.array(*[F.xxhash64(F.lit(i), F.substring(fingerprint, 4 * WIDTH * i + 1, 4 * WIDTH)) for i in range(BANDS)])


def in_bands(nodes: DataFrame) -> DataFrame:
    """``(node, size, bucket)`` of nodes with a ``fingerprint``, a row for each band."""
    return nodes.select("node", "size", F.explode(buckets_of(F.col("fingerprint"))).alias("bucket"))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sorted arrays of distinct shingles; 1 of two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def set_links(sets: list[np.ndarray], similarity: float) -> list[int]:
    """For each set the first one of its class: each in turn is compared with all, until one class is left."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    parent = np.arange(n)
    _, places = np.unique(np.concatenate(sets), return_inverse=True)
    places = places.astype(np.int32)
    starts, full = np.concatenate([[0], np.cumsum(sizes)]), np.flatnonzero(sizes)
    both, present = np.zeros(n, dtype=np.int64), np.zeros(int(places.max(initial=-1)) + 1, dtype=bool)
    for i in range(n):
        mine = places[starts[i] : starts[i + 1]]
        present[mine] = True
        if len(full):
            both[full] = np.add.reduceat(present[places], starts[full], dtype=np.int32)
        present[mine] = False
        every = sizes + sizes[i] - both
        near = np.unique(parent[(every == 0) | (both / np.maximum(every, 1) >= similarity)])
        if len(near) > 1:
            parent[np.isin(parent, near)] = near[0]
        if not parent.any():
            break
    return parent.tolist()


def similar_classes(
    rows: DataFrame, texts: DataFrame, judge: Judge, shingles: Callable[[str], np.ndarray], similarity: float, buckets: Callable[[DataFrame], DataFrame] = in_bands, index: Index = Listed
) -> DataFrame:
    """``(key, n, best)`` of the texts that are repeated or have a similar one: ``n`` rows have the text, ``best`` is the least ``rank`` of its class.

    ``rows`` is a written table ``row long, key binary, rank, size long, fingerprint``: each row's number,
    its text's digest, an order of rows, the number of its shingles and its signature. ``texts`` has the
    ``key, text`` of all rows. ``judge`` gives for each text of a small bucket the first one of its class,
    ``shingles`` a text's sorted set, ``buckets`` the ``(node, size, bucket)`` of ``(node, size, fingerprint)``,
    which it reads once or writes, and ``index`` an empty index for a block of a large bucket. Texts that aren't
    in the result are classes of their own.
    """
    firsts = written(rows.groupBy("key").agg(F.min("row").alias("node"), F.min("rank").alias("rank"), F.count("*").alias("n")))
    repeated = written(firsts.filter("n > 1").select("key", "node", "n"))
    nodes = joined(rows.select("row", "key", "size", "fingerprint"), repeated, "key", "left").filter("node is null or node = row")
    left = buckets(nodes.select(F.col("row").alias("node"), "size", "fingerprint"))
    shared = written(left.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    left = written(joined(left, shared, "bucket", "left_semi", few=0))
    h, g = F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64("node", F.lit(1)))
    met = left.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("load"), F.min("node").alias("first"), h.alias("h"), g.alias("g"))
    once = written(met.groupBy("n", "load", "first", "h", "g").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "load"))
    members = written(joined(left, once, "bucket", few=0).select("bucket", "node", "size", "n", "load"))
    in_some = written(firsts.select("node", "key").join(members.select("node").distinct(), "node", "left_semi"))
    of_node = written(_packed(joined(texts, in_some, "key")).groupBy("node").agg(F.first("packed").alias("packed")))  # copies meet before the shuffle

    links = written(_links_at_home(members, of_node, judge, shingles, similarity, index))
    classed = written(members.join(connected_components(links), "node", "left").select("bucket", "node", "n", "load", F.coalesce("root", "node").alias("root")))
    apart = classed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low < high")
    mixed = joined(classed.drop("n"), written(apart.select("bucket", "n")), "bucket", few=0)
    small = (F.col("n") <= FEW) & (F.col("load") <= LOAD)
    links = written(links.unionByName(_small_links(mixed.filter(small), of_node, judge)))
    large = mixed.filter(~small).select("bucket", "node", "n")
    if not large.isEmpty():
        links = _with_large_links(written(large), of_node, links, shingles, similarity, index)
    roots = connected_components(links)
    linked = written(firsts.join(roots, "node").select("key", "rank", "n", "root"))
    best = written(linked.groupBy("root").agg(F.min("rank").alias("best"), F.count("*").alias("n")))
    of_linked = joined(linked.select("key", "root", F.col("n").alias("copies")), best, "root").select("key", F.col("copies").alias("n"), "best")
    alone = firsts.filter("n > 1").join(linked.select("key"), "key", "left_anti").select("key", "n", F.col("rank").alias("best"))
    return written(of_linked.unionByName(alone))


def _packed(texts: DataFrame) -> DataFrame:
    """``(node, packed)``: texts travel compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([press.compress((t.as_py() or "").encode()) for t in b.column(1)], pa.binary())], ["node", "packed"])

    return texts.select("node", "text").mapInArrow(run, "node long, packed binary")


def _unpacked(packed: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(packed).decode()


def _links_at_home(members: DataFrame, texts: DataFrame, judge: Judge, shingles: Callable[[str], np.ndarray], similarity: float, index: Index) -> DataFrame:
    """Links within groups of nodes that have the same largest bucket."""
    home = members.groupBy("node").agg(F.max(F.struct("n", "bucket")).alias("s"), F.first("size").alias("size")).select("node", "size", F.col("s.bucket").alias("bucket"))
    home = written(home)
    groups = written(home.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("load")).filter("n > 1"))
    home = joined(home, groups, "bucket", few=0)
    small = (F.col("n") <= FEW) & (F.col("load") <= LOAD)
    links = written(_small_links(home.filter(small), texts, judge))
    large = written(home.filter(~small).select("bucket", "node", "n"))
    if large.isEmpty():
        return links
    texts = written(joined(texts, written(large.select("node")), "node", "left_semi"))
    todo, hubs_from = large, large
    for i, many in enumerate(PASSES):
        rank = F.row_number().over(W.partitionBy("bucket").orderBy(F.xxhash64("node", F.lit(i)), "node"))
        hubs = written(hubs_from.withColumn("r", rank).filter(F.col("r") <= many).select("bucket", "node", "n"))
        links = written(links.unionByName(_pass_links(todo, hubs, texts, shingles, similarity, index)))
        classed, largest = _largest_class(large, links)
        todo = written(joined(classed.drop("n"), largest, "bucket").filter("root <> largest").select("bucket", "node", "n"))
        hubs_from = joined(classed.drop("n"), largest, "bucket").filter("root = largest").select("bucket", "node", "n")
        if todo.isEmpty():
            break
    return links


def _largest_class(large: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of large buckets with their classes, and each bucket's largest class."""
    classed = written(large.join(connected_components(links), "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root")))
    sizes = classed.groupBy("bucket", "root", "n").agg(F.count("*").alias("c"))
    return classed, written(sizes.groupBy("bucket", "n").agg(F.max_by("root", F.struct("c", "root")).alias("largest")))


def _pass_links(todo: DataFrame, hubs: DataFrame, texts: DataFrame, shingles: Callable[[str], np.ndarray], similarity: float, index: Index) -> DataFrame:
    """A link from each member to the first hub of its bucket that its index finds similar to it; a hub gets all."""
    blocks = F.ceil(F.col("n") / BLOCK_OF).cast("int")
    rows = todo.select("bucket", "node", F.pmod(F.xxhash64("node", F.lit(5)), blocks).cast("int").alias("block"), F.lit(False).alias("is_hub"))
    ends = hubs.select("bucket", "node", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(True).alias("is_hub"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, index()
        for b in batches:
            found = []
            for bucket, block, is_hub, node, packed in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4), strict=True):
                if (bucket, block) != now:
                    now, held = (bucket, block), index()
                mine = shingles(_unpacked(packed.as_py()))
                if not is_hub and node in held:
                    continue
                for hub, other in held.near(mine):  # the hubs come first
                    if jaccard(mine, other) >= similarity:
                        found.append((min(hub, node), max(hub, node)))
                        if not is_hub:
                            break
                if is_hub:
                    held.add(node, mine)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = rows.unionByName(ends).join(texts, "node").select("bucket", "block", "is_hub", "node", "packed").repartition("bucket", "block")
    return dealt.sortWithinPartitions("bucket", "block", F.desc("is_hub"), "node").mapInArrow(run, "a long, b long")


def _small_links(members: DataFrame, texts: DataFrame, judge: Judge) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, held = None, [], []
        for b in batches:
            for bucket, node, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if bucket != now:
                    yield judged(nodes, held)
                    now, nodes, held = bucket, [], []
                nodes.append(node)
                held.append(_unpacked(packed.as_py()))
        yield judged(nodes, held)

    def judged(nodes: list[int], held: list[str]) -> pa.RecordBatch:
        of = judge(held) if held else []
        linked = [(nodes[f], nodes[i]) for i, f in enumerate(of) if f != i]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in linked], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = members.select("bucket", "node").join(texts, "node").select("bucket", "node", "packed")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(run, "a long, b long")


def _with_large_links(large: DataFrame, texts: DataFrame, links: DataFrame, shingles: Callable[[str], np.ndarray], similarity: float, index: Index) -> DataFrame:
    """``links`` and those within the large buckets (``bucket, node, n``)."""
    texts = written(joined(texts, written(large.select("node").distinct()), "node", "left_semi"))
    hubs, many = None, HUBS[0]
    while True:
        classed, largest = _largest_class(large, links)
        open_ = joined(classed.drop("n"), largest, "bucket").filter("root <> largest")
        if hubs is not None:
            open_ = open_.join(hubs.select("bucket", "node"), ["bucket", "node"], "left_anti")
        # equal members of different buckets become hubs together, so that their pairs are the same
        rank = F.row_number().over(W.partitionBy("bucket").orderBy(F.xxhash64("node"), "node"))
        new = written(open_.withColumn("r", rank).filter(F.col("r") <= many).select("bucket", "node", "n", "root"))
        if new.isEmpty():
            return links
        hubs = new if hubs is None else hubs.unionByName(new)
        many = min(HUBS[2], many * HUBS[1])
        links = written(links.unionByName(_hub_links(classed, new, texts, shingles, similarity, index)))


def _hub_links(classed: DataFrame, hubs: DataFrame, texts: DataFrame, shingles: Callable[[str], np.ndarray], similarity: float, index: Index) -> DataFrame:
    """Links between hubs and all members of other classes in their buckets, each pair compared once."""
    of_bucket = written(hubs.groupBy("bucket", "n").agg(F.collect_list(F.struct("node", "root")).alias("hubs")))  # at most HUBS[2] in a row
    pairs = joined(classed.select("bucket", "node", "root"), of_bucket, "bucket").select("node", "n", "root", F.explode("hubs").alias("hub"))
    pairs = pairs.filter("hub.root <> root").select("node", "n", F.col("hub.node").alias("hub"))
    blocks = F.ceil(F.col("n") / BLOCK_OF).cast("int")
    pairs = pairs.groupBy("hub", "node").agg(F.max("n").alias("n")).select("hub", "node", blocks.alias("blocks"))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    ends = hubs.select(F.col("node").alias("hub"), blocks.alias("blocks")).distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = pairs.unionByName(ends.withColumn("node", F.col("hub"))).join(texts, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, of_hub = None, None
        for b in batches:
            found = []
            for hub, blocks_, block, node, packed in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4), strict=True):
                if (hub, blocks_, block) != now:  # the hub comes first
                    now, of_hub = (hub, blocks_, block), index()
                    of_hub.add(hub, shingles(_unpacked(packed.as_py())))
                    continue
                mine = shingles(_unpacked(packed.as_py()))
                if any(jaccard(mine, other) >= similarity for _, other in of_hub.near(mine)):
                    found.append((min(hub, node), max(hub, node)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = rows.select("hub", "blocks", "block", "node", "packed").repartition("hub", "blocks", "block")
    return dealt.sortWithinPartitions("hub", "blocks", "block", F.col("hub") != F.col("node"), "node").mapInArrow(run, "a long, b long")
