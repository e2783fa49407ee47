"""Operator 1, SimHash near-duplicates found with BK-trees.

A fingerprint has 64 bits; documents are linked when their fingerprints differ in at most ``radius``
bits, and the classes are the components of these links.

Two fingerprints within the radius agree on at least one of ``radius + 1`` groups of bits, so the
fingerprints are sharded by (group, bits in it) and a link is never cut. Each shard becomes one
BK-tree, whose children are keyed by their integer distance to the parent; a search follows only the
edges within the radius of the distance at hand. A shard with more than ``SHARD`` fingerprints is
dealt anew on groups of its free bits, up to ``LEVELS`` times. After the last level some 13 bits are
free, so a shard never holds more than some 2**13 fingerprints: that is the bound of a tree, whatever
the data. Trees travel to tasks by the shuffle on the shard key; nothing that grows with the corpus
is broadcast or collected. Equal fingerprints are merged before, so exact copies cost one node.

The pipeline's stage (:func:`one_of_each`) links texts of five-word Jaccard similarity 0.8 or more. Its
fingerprints are of the distinct five-word shingles, the sets that are compared, so lines that are repeated
move no text away from its likes. They have ``WIDE`` bits, of which likes differ in up to ``RADIUS``: too many
for groups that share all of them, so more bits are taken, in as many groups as it takes for likes to agree on
one (:func:`shape`). Again each (group, bits in it) is a shard and each shard one BK-tree, and classes of what
is found within the radius are verified on the whole texts. A shard of more than ``HELD`` is dealt to blocks, and
each pair of blocks becomes a tree. Classes of more than ``bands.FEW`` texts are not gathered to be verified: they are
compared block by block with some of them, which are held in a BK-tree too.

Ties: a bit that is set in exactly half of the hashes is 0, in the stage that of the least hash; of rows that share the smallest id of a class, the first one read stays.
Nulls and texts without words have fingerprint zero and are linked like any other. Repeated rows get
the same class. A null id takes part in a class but is never its smallest id, unless all are null. A text
of any length is one row of a task; its hashes are counted in blocks. An empty table gives no rows. Other
columns, whatever their names, are not read, and :func:`one_of_each` gives them back as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, pairwise
from math import ceil, log, log1p, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bands, minhash
from barloom.llm.common import joined, sliced, table, text_key, without, written
from barloom.llm.graph import connected_components

BITS = 64
SHARD = 2_000
LEVELS = 4
CHUNK = 1 << 16
#: Similarity that the stage's figures are made for, and the chance that a bit differs then: 0.15, and most, 0.1875, for sets of 4 and 5.
SIMILAR, APART = 0.8, 0.1875
#: Bits of the stage's fingerprints and the radius: more bits than it differ with a chance of 5e-7 in such sets, no more in others with 2e-6.
WIDE, RADIUS = 192, 64
#: Unlike texts that meet in a shard of the stage, about half of it to all, and the chance that such sets agree on no group of bits.
MET, MISSED = 1_024, 5e-5
#: Values of a subtree that are kept as a list, and those of a shard that are dealt to one block.
LEAF, HELD = 64, 1 << 15


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """Bit i is set if it is set in over half of the XXH64 (seed 42) of the word shingles, repeats included."""
    w = data.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else [b" ".join(w)]
    return of_hashes(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype="<u8"))


def of_hashes(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the 64-bit hashes; 0 of none."""
    hashes, ones = hashes.astype("<u8", copy=False), np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)``, one row for each row of ``docs``; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py() or b"", shingle) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, f"doc_id {kind}, fp long")


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The number of the value's node."""
        at = 0
        while self.values:
            d = (self.values[at] ^ value).bit_count()
            if d == 0:
                return at
            if d not in self.children[at]:
                self.children[at][d] = len(self.values)
                break
            at = self.children[at][d]
        self.values.append(value)
        self.children.append({})
        return len(self.values) - 1

    def near(self, value: int, radius: int) -> Iterator[int]:
        """The numbers of the nodes within the radius."""
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            children = self.children[at]
            if len(children) <= 2 * radius + 1:
                stack.extend(c for k, c in children.items() if d - radius <= k <= d + radius)
            else:
                stack.extend(children[k] for k in range(d - radius, d + radius + 1) if k in children)


def shard_links(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """One link to its class's first value for each value of a shard that has a neighbour in it: never all pairs."""
    tree, parent = BKTree(), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for v in values:
        i = len(parent)
        parent.append(i)
        for j in tree.near(v, radius):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
        tree.add(v)
    for i, v in enumerate(values):
        if root(i) != i:
            yield v, values[root(i)]


def _masks(radius: int, levels: int) -> list[list[int]]:
    """Masks of the bits that a shard of each level agrees on; shard p of a level has the children p*(radius+1)+k."""
    out, agreed = [], [0]
    for _ in range(levels):
        nxt = []
        for mask in agreed:
            free = [i for i in range(BITS) if not mask >> i & 1]
            for part in np.array_split(free, radius + 1):
                nxt.append(mask | sum(1 << int(i) for i in part))
        out.append(nxt)
        agreed = nxt
    return out


def links(fps: DataFrame, radius: int = 2, fp_col: str = "fp") -> DataFrame:
    """``(a, b)`` links between distinct fingerprints whose components are those of all pairs within the radius."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = _masks(radius, LEVELS)
    at = fps.select(F.col(fp_col).alias("fp")).dropna().distinct().withColumn("path", F.lit(0))
    done = None
    for level, of_level in enumerate(masks):
        table_ = F.array(*[F.lit(signed(m)).cast("long") for m in of_level])
        kids = F.explode(F.sequence(F.col("path") * (radius + 1), F.col("path") * (radius + 1) + radius))
        at = at.select("fp", kids.alias("path")).withColumn("shard", F.col("fp").bitwiseAND(F.get(table_, F.col("path"))))
        at = at.withColumn("level", F.lit(level))
        if level + 1 < len(masks):
            large = written(at.groupBy("path", "shard").count().filter(F.col("count") > SHARD).select("path", "shard"))
            if large.isEmpty():
                done = at if done is None else done.unionByName(at)
                break
            small = at.join(large, ["path", "shard"], "left_anti").select("fp", "path", "shard", "level")
            done = small if done is None else done.unionByName(small)
            at = at.join(large, ["path", "shard"], "left_semi").select("fp", "path")
        else:
            done = done.unionByName(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        a, c = [], []
        for _, group in groupby(rows(), key=lambda r: r[:3]):
            values = [r[3] & (1 << 64) - 1 for r in group]
            if len(values) > 1:
                for x, y in shard_links(values, radius):
                    a.append(x)
                    c.append(y)
            if len(a) >= 1 << 15:
                yield batch(a, c)
                a, c = [], []
        yield batch(a, c)

    def batch(a: list[int], c: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, c)], ["a", "b"])

    dealt = done.select("level", "path", "shard", "fp").repartition("level", "path", "shard").sortWithinPartitions("level", "path", "shard", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row: the class is named by its smallest id."""
    fps = written(fingerprints(docs, id_col, text_col, shingle))
    firsts = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = connected_components(links(firsts, radius))
    classed = written(firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    lowest = classed.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = written(classed.join(lowest, "root").select("fp", "component_id", "n"))
    return joined(fps, by_fp, "fp").select("doc_id", "fp", "component_id")


def hashed(shingles: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit hashes of each shingle, a row for each."""
    x = shingles.astype(np.uint64)[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x ^ x >> np.uint64(31)).astype("<u8", copy=False)


#: For each byte its bits in eight bytes, so that up to 255 of them add up without a carry.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def wide_fingerprint(shingles: np.ndarray, words: int = WIDE // 64) -> np.ndarray:
    """``words`` 64-bit words of a sorted set: a bit is set if it is in over half of the hashes; of a tie, the least shingle decides. 0 of none."""
    ones = np.zeros(64 * words, dtype=np.int64)
    for i in range(0, len(shingles), 255):
        ones += SPREAD[hashed(shingles[i : i + 255], words).view(np.uint8)].sum(axis=0, dtype=np.uint64).view(np.uint8)
    first = np.unpackbits(hashed(shingles[:1], words).view(np.uint8), bitorder="little") if len(shingles) else 0
    return np.packbits(2 * ones + first > len(shingles), bitorder="little").view("<u8")


def shape(rows: int) -> tuple[int, int]:
    """How many bits a group has, so that a shard holds up to ``MET`` of as many unlike rows, and how many groups it takes for likes to agree on one."""
    bits = max(0, ceil(log2(max(rows, 1) / MET)))
    return bits, ceil(log(MISSED) / log1p(-((1 - APART) ** bits))) if bits else 1


class Tree(bands.Listed):
    """An index of sets by a BK-tree of their fingerprints: gives those within the radius.

    A search of so many bits follows most edges: what the tree saves is comparing sets, not fingerprints.
    """

    def __init__(self, radius: int = RADIUS) -> None:
        super().__init__()
        self.radius, self.tree, self.members, self.last = radius, BKTree(), [], (None, 0)

    def of(self, shingles: np.ndarray) -> int:
        if self.last[0] is not shingles:
            self.last = (shingles, int.from_bytes(wide_fingerprint(shingles).tobytes(), "little"))
        return self.last[1]

    def add(self, name: int, shingles: np.ndarray) -> None:
        super().add(name, shingles)
        at = self.tree.add(self.of(shingles))
        if at == len(self.members):
            self.members.append([])
        self.members[at].append(name)

    def near(self, shingles: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for node in self.tree.near(self.of(shingles), self.radius):
            for name in self.members[node]:
                yield name, self.sets[name]


def tree_judged(texts: list[str], similarity: float, radius: int = RADIUS) -> list[int]:
    """For each text the first one of its class: a BK-tree of the fingerprints of their sets gives the candidates, Jaccard's similarity decides."""
    tree, parent = Tree(radius), list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, t in enumerate(texts):
        mine = minhash.shingle_set(t)
        for j, other in tree.near(mine):
            a, b = root(i), root(j)
            if a != b and bands.jaccard(mine, other) >= similarity:
                parent[max(a, b)] = min(a, b)
        tree.add(i, mine)
    return [root(i) for i in range(len(texts))]


def shard_classes(values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint (a column of words) the first one of its class of those linked within the radius.

    The BK-tree of the values in their order is made from the root down: each subtree's first value is its node, the
    others go to children by their distance to it. All searches that reach a node are made at once, each of
    the later values; the subtrees of up to ``LEAF`` values are lists.
    """
    parent = np.arange(values.shape[1])
    stack = [(parent.copy(), parent.copy())]  # the values of a subtree, those that are searched for in it
    while stack:
        tree, sought = stack.pop()
        held = tree if len(tree) <= LEAF else tree[:1]
        sought = sought[np.searchsorted(sought, held[0], side="right") :]
        away = np.zeros((len(held), len(sought)), dtype=np.uint8)
        for word in values:
            away += np.bitwise_count(word[held][:, None] ^ word[sought])
        away[np.arange(1, len(held)), np.searchsorted(sought, held[1:])] = 255  # a value itself
        near = away <= radius
        for i in np.flatnonzero(near.any(axis=1)):
            mine, others = parent[held[i]], parent[sought[near[i]]]
            if (others != mine).any():
                roots = np.unique(np.append(others, mine))
                parent[np.isin(parent, roots)] = roots[0]
        if len(held) < len(tree):
            rest, away = tree[1:], away[0].astype(np.int16)
            edge = away[np.searchsorted(sought, rest)]  # values of a subtree are sought in it
            for d in np.unique(edge):
                stack.append((rest[edge == d], sought[np.abs(away - d) <= radius]))
    return parent


def in_shards(nodes: DataFrame, bits: int, groups: int, radius: int = RADIUS) -> DataFrame:
    """``(node, size, bucket)``: a bucket is a class of two or more fingerprints that the BK-tree of a shard, or of two blocks of it, links."""
    words = WIDE // 64
    fps = [f"w{i}" for i in range(words)]

    def shards(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        fp = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype="<u8").reshape(b.num_rows, -1)
        of = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")[:, WIDE : WIDE + groups * bits].reshape(b.num_rows, groups, bits)
        return fp[:, :words].view(np.int64), ((np.arange(groups, dtype=np.int64) << bits) + of @ (np.int64(1) << np.arange(bits, dtype=np.int64))).ravel()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array(shards(b)[1], pa.int64())], ["shard"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fp, shard = shards(b)
            columns = [shard, *(np.repeat(x, groups) for x in (b.column(0).to_numpy(), b.column(1).to_numpy(), *fp.T))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["shard", "node", "size", *fps])

    def searched(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if sum(len(c[0]) for c in held) < 2:
            return
        shard, pair, node, size, *fp = (np.concatenate(c) for c in zip(*held, strict=True))
        root = shard_classes(np.array(fp).view(np.uint64), radius)
        of = np.flatnonzero(np.bincount(root)[root] > 1)
        if len(of):
            columns = (shard[of], pair[of], node[of], size[of], node[root[of]])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["shard", "pair", "node", "size", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            columns = [c.to_numpy() for c in b.columns]
            cuts = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)) + 1
            for lo, hi in pairwise([0, *cuts.tolist(), b.num_rows] if b.num_rows else []):
                part = [c[lo:hi] for c in columns]
                if (part[0][0], part[1][0]) != now:
                    yield from searched(held)
                    now, held = (part[0][0], part[1][0]), []
                held.append(part)
        yield from searched(held)

    nodes = nodes.select("node", "size", "fingerprint")
    blocks = F.ceil(F.col("n") / HELD).alias("blocks")
    large = written(nodes.mapInArrow(count, "shard long").groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > HELD).select("shard", blocks))
    dealt = nodes.mapInArrow(deal, ", ".join(f"{c} long" for c in ["shard", "node", "size", *fps]))
    if large.isEmpty():
        dealt = dealt.withColumn("pair", F.lit(0).cast("long"))
    else:
        dealt = dealt.join(F.broadcast(large), "shard", "left")
        mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
        others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: other != mine)
        pairs = F.transform(others, lambda other: F.least(mine, other) * F.col("blocks") + F.greatest(mine, other))
        dealt = dealt.withColumn("pair", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)))
    dealt = dealt.select("shard", "pair", "node", "size", *fps).repartition("shard", "pair").sortWithinPartitions("shard", "pair", "node")
    found = written(dealt.mapInArrow(run, "shard long, pair long, node long, size long, first long"))
    return found.select("node", "size", F.xxhash64("shard", "pair", "first").alias("bucket"))


def similar_classes(rows: DataFrame, texts: DataFrame, bits: int, groups: int, similarity: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """``(key, n, best)`` of similar texts, see :func:`barloom.llm.bands.similar_classes`: shards of fingerprints and their BK-trees give the candidates."""
    judge = lambda held: tree_judged(held, similarity, radius)
    buckets = lambda nodes: in_shards(nodes, bits, groups, radius)
    return bands.similar_classes(rows, texts, judge, minhash.shingle_set, similarity, buckets, lambda: Tree(radius))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILAR) -> DataFrame:
    """One row of each class of similar texts, with its columns as they are: the one with the smallest id.

    Rows are told apart by number, not by id: of repeated rows one stays, of rows that share an id each class
    keeps its own, and rows without an id stay only where their class has no other. Null texts are empty.
    The fingerprints are made for similarities of ``SIMILAR`` or more.
    """
    if similarity < SIMILAR:
        raise ValueError(f"fingerprints find similarities of {SIMILAR} or more, not {similarity}")
    # the row in a struct, so that no name of ``docs`` clashes
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held")))
    bits, groups = shape(rows.count())
    words = WIDE // 64 + -(-bits * groups // 64)
    keyed = rows.select("row", F.col(f"held.{id_col}").alias("doc_id"), text_key(F.col(f"held.{text_col}")).alias("key"), F.col(f"held.{text_col}").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = [minhash.shingle_set(t.as_py() or "") for t in b.column(3)]
            size, fp = pa.array([len(x) for x in sets], pa.int64()), pa.array([wide_fingerprint(x, words).tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), size, fp], ["row", "doc_id", "key", "size", "fingerprint"])

    signed = written(keyed.mapInArrow(run, f"row long, doc_id {keyed.dtypes[1][1]}, key binary, size long, fingerprint binary"))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    signed = signed.withColumn("rank", rank)
    found = similar_classes(signed, keyed.select("key", "text"), bits, groups, similarity)
    gone = written(joined(signed.select("row", "key"), found, "key").filter("row <> best.row").select("row"))
    return without(rows, gone, "row").select("held.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
