"""Operator 3, conflict-constrained best-fit packing of token sequences into bins of a fixed capacity.

Whole texts are encoded; pieces are taken in order of falling length. Bins are ordered by what room they
have left; the search starts at the tightest bin that fits and goes on to its successors until one is
compatible, and a new bin is opened when none is. A bin carries two bitmaps: of sources that have reached
their quota in it (``per_source`` pieces), and of duplicate clusters (hashed to ``CLUSTER_BITS`` bits): a
piece whose bit is set is in conflict. Two clusters that share a bit only cost a needless conflict, never a
duplicate within a bin. By default a cluster is the texts with equal ids (case and white space don't count in this vocabulary);
a column of class ids, such as those of :func:`barloom.llm.minhash.near_duplicates`, makes near copies conflict too.

A document longer than the capacity fills whole bins of its own and its rest is packed like the
others, so nothing is dropped or cut off: ``offset`` tells where a piece starts in the document's ids.
Documents are dealt to shards by a hash of id and text, whatever their source or cluster, about ``SHARD``
documents or ``SHARD_BYTES`` bytes of text each, and each shard is packed on its own: a bounded group,
whose number grows with the data. Ids take two bytes a token on their way.

Documents without tokens (null, empty) are in no bin: one row of length 0, bin and start null. A null source
is a source of its own. Rows that share an id, repeated rows too, are documents of their own; ties of length
go by id, then by the ids' bytes. A text of any length is one row of a task. An empty table gives no rows. Ids
may be of any type that sorts. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import groups_of, sliced, table
from barloom.llm.records import encoder, word_bpe_path

CAPACITY = 2_048
PER_SOURCE = 8
CLUSTER_BITS = 1_024
SHARD, SHARD_BYTES = 8_192, 64 << 20
#: A task packs several shards, one after the other, where there are more.
MAX_TASKS = 20_000


class Bins:
    """Open bins by residual, with their bitmaps."""

    def __init__(self, capacity: int, per_source: int) -> None:
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []  # (residual, bin), ascending
        self.full: list[int] = []  # bitmap of sources at their quota
        self.clusters: list[int] = []
        self.of_source: list[dict[int, int]] = []
        self.used: list[int] = []

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin that takes the piece, and where in it the piece starts."""
        s_bit, c_bit = 1 << source, 1 << cluster
        full, clusters = self.full, self.clusters
        for i in range(bisect_left(self.order, (length, -1)), len(self.order)):
            residual, b = self.order[i]
            if not (full[b] & s_bit or clusters[b] & c_bit):
                del self.order[i]
                break
        else:
            b, residual = len(full), self.capacity
            full.append(0)
            clusters.append(0)
            self.of_source.append({})
            self.used.append(0)
        n = self.of_source[b][source] = self.of_source[b].get(source, 0) + 1
        if n >= self.per_source:
            full[b] |= s_bit
        clusters[b] |= c_bit
        at = self.used[b]
        self.used[b] += length
        if residual - length > 0:
            insort(self.order, (residual - length, b))
        return b, at


def pack_shard(rows: list[tuple], capacity: int, per_source: int) -> Iterator[tuple]:
    """``(i, piece, bin, start, length)`` for rows ``(order, length, source, cluster)``: the i-th row's pieces; ties of length go by order, cluster and source."""
    bins = Bins(capacity, per_source)
    numbers: dict[str | None, int] = {}
    rest, whole = [], []
    for i, (order, length, source, cluster) in enumerate(rows):
        pieces, left = divmod(length, capacity)
        whole += [(order, p, i) for p in range(pieces)]
        if left:
            rest.append((-left, order, cluster, source is None, source or "", pieces, i))
        elif not pieces:
            yield i, 0, None, None, 0
    for left, _, cluster, no_source, source, piece, i in sorted(rest):
        s = numbers.setdefault(None if no_source else source, len(numbers))
        b, at = bins.place(-left, s, cluster % CLUSTER_BITS)
        yield i, piece, b, at, -left
    for k, (_, p, i) in enumerate(sorted(whole)):
        yield i, p, len(bins.full) + k, 0, capacity


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, path: str | None = None, shard: int = SHARD) -> DataFrame:
    """``(doc_id, piece, bin_id, start, length, offset, ids)``: every piece of every row of ``docs`` in one bin.

    ``ids`` are the piece's token ids, little-endian, two bytes each (four where the vocabulary is larger);
    ``cluster_col`` names a column of longs that is equal for duplicates.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length(text)).alias("bytes")).first()
    shards = max(1, -(-n["rows"] // shard), -(-(n["bytes"] or 0) // SHARD_BYTES))
    cluster = F.col(cluster_col).cast("long") if cluster_col else F.lit(None).cast("long")
    number = F.pmod(F.xxhash64(id_col, text, F.lit(17)), F.lit(shards)).cast("int")
    d = docs.select(number.alias("shard"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"), text.alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path or word_bpe_path())
        for b in sliced(batches):
            texts = b.column("text").to_pylist()
            ids = [_narrow(x, e.wide) for g in groups_of(texts) for x in e.encode(g)]
            own = pa.array([xxhash.xxh64_intdigest(x) - (1 << 63) if c is None else c for x, c in zip(ids, b.column("cluster").to_pylist(), strict=True)], pa.int64())
            n = pa.array([len(x) // e.wide for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("doc_id"), b.column("source"), own, n, pa.array(ids, pa.binary())], ["shard", "doc_id", "source", "cluster", "n", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, id_type = None, [], None
        for b in sliced(batches):
            id_type = b.column(1).type
            for s, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != now and rows:
                    yield from packed(now, rows, id_type)
                    rows = []
                now = s
                rows.append(row)
        if rows:
            yield from packed(now, rows, id_type)

    def packed(s: int, rows: list[list], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        lengths = [((doc_id is None, "" if doc_id is None else doc_id, ids), n, source, cluster) for doc_id, source, cluster, n, ids in rows]
        wide = max((len(r[4]) // r[3] for r in rows if r[3]), default=2)
        out = sorted(pack_shard(lengths, capacity, per_source), key=lambda r: (r[2] is None, r[2] or 0, r[3] or 0))
        for at in range(0, len(out), 1_000):
            i, piece, bin_, start, length = zip(*out[at : at + 1_000], strict=True)
            offset = [p * capacity for p in piece]
            ids = [rows[k][4][o * wide : (o + n) * wide] for k, o, n in zip(i, offset, length, strict=True)]
            bin_id = [None if x is None else (s << 32) + x for x in bin_]
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[k][0] for k in i], id_type), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (bin_id, start, length, offset)), pa.array(ids, pa.binary())],
                ["doc_id", "piece", "bin_id", "start", "length", "offset", "ids"],
            )

    tasks = min(shards, MAX_TASKS)
    encoded = d.mapInArrow(encode, f"shard int, doc_id {kind}, source string, cluster long, n long, ids binary")
    dealt = encoded.repartitionById(tasks, F.pmod(F.col("shard"), F.lit(tasks))).sortWithinPartitions("shard")
    return dealt.mapInArrow(run, f"doc_id {kind}, piece int, bin_id long, start long, length long, offset long, ids binary")


def _narrow(ids: bytes, wide: int) -> bytes:
    return ids if wide == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"))
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
