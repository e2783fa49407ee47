"""Operator 11, importance resampling towards a target by a dictionary of distinct features.

A text's words are runs of letters and digits (ASCII letters lower-cased) and of all characters beyond ASCII; its
features are all runs of 1 to ``RUN`` words, repeats included. One pass counts the feature strings of the whole
corpus: each task first counts those of a block of texts, so a frequent string travels once a block, and sends them
in order, which compresses well. Each distinct string is then hashed once to its bucket, buckets are summed, and
those of the corpus and of the target give each bucket's gain, the logarithm of its rate in the target over its rate
in the corpus. The gains, one number for each of the ``BUCKETS`` buckets whatever the data, go back to the
documents: a block's dictionary takes the gain of each of its distinct strings once, and a document's weight is the mean
over its feature counts. (A join of strings instead of buckets would send each document's features through a
shuffle, several times the input.)

A document's score adds Gumbel noise, drawn from its id, to the weight; the highest scores among documents with at
least ``LEAST_WORDS`` words are a sample without replacement. Ranks come from one sort by ranges, with the number of
rows before each range: no task sees all rows.

Null and empty texts have no words: weight 0, never drawn. A null id draws the noise of an empty one and comes last
among ties. Ties go to the smaller id; rows that share id and score, repeated rows too, are ranked one after the
other. A text of any length is one row of a task. An empty table gives no rows; with an empty target all
gains come from the corpus alone. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import sliced, table, text_key, written

BUCKETS, RUN, LEAST_WORDS, SHARE, SEED = 10_000, 2, 20, 25, 7
#: Words of a block: it holds the dictionary of texts of about so many words, or of one longer text.
BLOCK_WORDS = 4_000_000
WEIGHED_WORDS = 500_000
#: Rows that a task ranks, about.
ROWS_PER_RANGE = 1_000_000
#: What each byte becomes: A-Z become a-z, other ASCII nothing; bytes beyond ASCII are those of word characters.
_KEPT = np.array([b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else 0 for b in range(256)], dtype=np.uint8)


class Block:
    """Some texts, and the dictionary of their distinct features."""

    def __init__(self) -> None:
        self.letters: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []  # of words, in bytes
        self.n_words: list[np.ndarray] = []  # of texts
        self.total = 0

    def add(self, texts: pa.Array) -> None:
        """Cuts the texts of a column of strings into words, all at once; a word ends with its text."""
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
        until = np.cumsum(size)
        raw = _KEPT[np.frombuffer(b"".join(t.as_buffer() for t in texts if t.is_valid), dtype=np.uint8)]
        kept = raw > 0
        first, last = kept.copy(), kept.copy()
        first[1:] &= ~kept[:-1]
        last[:-1] &= ~kept[1:]
        some = size > 0
        starts, ends = (until - size)[some], until[some] - 1
        first[starts], last[ends] = kept[starts], kept[ends]
        begin = np.flatnonzero(first)
        self.letters.append(raw[kept])
        self.sizes.append(np.flatnonzero(last) + 1 - begin)
        self.n_words.append(np.diff(np.searchsorted(begin, until), prepend=0))
        self.total += len(begin)

    def numbered(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct words in order, and the number of the word at each place."""
        ends = np.cumsum(np.concatenate([[0], *self.sizes]), dtype=np.int32)
        every = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, *map(pa.py_buffer, (ends, np.concatenate([_KEPT[:0], *self.letters])))]).dictionary_encode()
        order = pc.sort_indices(every.dictionary)
        rank = np.empty(len(order), dtype=np.int32)
        rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
        return every.dictionary.take(order), rank[every.indices.to_numpy()]

    def runs(self, longest: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """For each length of runs: the distinct runs, and for each place that begins one the place and the run's number."""
        single, at = self.numbered()
        strings, number, places, left = single, at, np.arange(len(at), dtype=np.int32), self._left()
        yield strings, places, number
        for k in range(1, longest):
            places, codes = _longer(k, len(single), at, left, places, number)
            distinct, number = np.unique(codes, return_inverse=True)
            strings = _joined(distinct, strings, single)
            yield strings, places, number

    def counted(self, longest: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """For each length of runs the distinct ones, by their first words, and how often they occur; the longest are only sorted."""
        single, at = self.numbered()
        strings, number, places, left = single, at, np.arange(len(at), dtype=np.int32), self._left()
        yield strings, np.bincount(number, minlength=len(strings))
        for k in range(1, longest):
            places, codes = _longer(k, len(single), at, left, places, number)
            if k + 1 < longest:
                distinct, number, n = np.unique(codes, return_inverse=True, return_counts=True)
            else:
                codes.sort()
                new = np.flatnonzero(np.diff(codes, prepend=-1))
                distinct, n = codes[new], np.diff(new, append=len(codes))
                del codes
            strings = _joined(distinct, strings, single)
            yield strings, n

    def _left(self) -> np.ndarray:
        """The number of words from each place to its text's end."""
        n = np.concatenate([np.zeros(0, dtype=np.int64), *self.n_words])
        return (np.repeat(np.cumsum(n), n) - np.arange(self.total)).astype(np.int32)


def _longer(k: int, words: int, at: np.ndarray, left: np.ndarray, places: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of runs of ``k`` words that go on, and a code of each run with the next word."""
    go_on = left[places] > k
    places = places[go_on]
    return places, number[go_on] * np.int64(words) + at[places + k]


def _joined(codes: np.ndarray, runs: pa.Array, single: pa.Array) -> pa.Array:
    first, last = (pa.array(x) for x in np.divmod(codes, max(1, len(single))))
    return pc.binary_join_element_wise(runs.take(first), single.take(last), b" ")


def _blocks(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[tuple[list[pa.RecordBatch], Block]]:
    """The batches in slices, with the block of their texts."""
    held, block = [], Block()
    for b in sliced(batches, 128):
        held.append(b)
        block.add(b.column(column))
        if block.total >= most:
            yield held, block
            held, block = [], Block()
    if held:
        yield held, block


def crc32(strings: pa.Array) -> np.ndarray:
    """The unsigned CRC-32 of each string: all at once, byte by byte; long ones by zlib."""
    ends = np.frombuffer(strings.buffers()[1], dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(strings.buffers()[2] or b"", dtype=np.uint8)
    size = np.diff(ends)
    crc = np.full(len(strings), 0xFFFFFFFF, dtype=np.uint32)
    live = np.flatnonzero(size <= LONG)
    for i in range(LONG):
        live = live[size[live] > i]
        if not len(live):
            break
        crc[live] = _CRC[(crc[live] ^ data[ends[live] + i]) & np.uint32(255)] ^ crc[live] >> np.uint32(8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG):
        crc[i] = zlib.crc32(data[ends[i] : ends[i + 1]])
    return crc


LONG = 64
#: The checksum's step for each byte: checksums of equal lengths differ as those of what their texts differ by.
_CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)


def feature_counts(texts: DataFrame, text_col: str = "text", longest: int = RUN) -> DataFrame:
    """``(feature, n)``: each distinct feature string of the whole table and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches, 0, BLOCK_WORDS):
            for strings, n in block.counted(longest):
                strings, n = strings.cast(pa.string()), pa.array(n)
                for i in range(0, len(strings), 1 << 16):
                    yield pa.RecordBatch.from_arrays([strings[i : i + (1 << 16)], n[i : i + (1 << 16)]], ["feature", "n"])

    counted = texts.select(text_col).mapInArrow(run, "feature string, n long")
    return counted.repartition("feature").groupBy("feature").agg(F.sum("n").alias("n"))  # one shuffle: the blocks have been summed already


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)`` of the buckets that have features, from :func:`feature_counts`: each distinct string is hashed once."""
    bucket = F.pmod(F.crc32("feature"), F.lit(buckets))
    return feature_counts(texts, text_col, longest).groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, gain)`` of all buckets, from the bucket counts of both, in thousandths of a natural logarithm."""
    every = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    both = written(both.select("bucket", F.col("s").cast("double"), F.col("t").cast("double")))
    of_all = both.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("all_t"))
    rate = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return both.join(F.broadcast(of_all)).select("bucket", F.floor(F.lit(1000.0) * F.log(rate)).alias("gain"))  # of_all: one row


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = RUN) -> DataFrame:
    """``(doc_id, key, n_words, n_features, weight)`` per row; ``key`` is a digest of the text, ``gain`` has the gain of each bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bucket = shared.value
        for held, block in _blocks(batches, 2, WEIGHED_WORDS):
            n_words = np.concatenate(block.n_words)
            ends = np.cumsum(n_words)
            n, total = np.zeros(len(ends), dtype=np.int64), np.zeros(len(ends), dtype=np.int64)
            for strings, places, number in block.runs(longest):
                bucket = crc32(strings) % np.uint32(len(of_bucket))
                sums = np.concatenate([[0], np.cumsum(of_bucket[bucket][number])])
                until = np.searchsorted(places, ends)  # runs that begin in a text or before
                n += np.diff(until, prepend=0)
                total += np.diff(sums[until], prepend=0)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            at = 0
            for b in held:
                of = slice(at, at := at + b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x[of]) for x in (n_words, n, weight))], ["doc_id", "key", "n_words", "n_features", "weight"])

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    return keyed.mapInArrow(run, "doc_id long, key binary, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the seed and the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (``doc_id, n_words, score`` and others) with the ``rank`` of the drawn rows: the best ``share`` hundredths of those with enough words."""
    rows = written(scored.withColumn("row", F.monotonically_increasing_id()))
    few = F.col("n_words") < least_words
    order = [few, F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row")]
    n = rows.agg(F.count("*").alias("all"), F.count_if(~few).alias("enough")).first()
    parts = max(2, -(-n["all"] // ROWS_PER_RANGE), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the position in a partition and its number, by range in the order of the ranks
    placed = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("row").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = list(zip((p for p, _ in sizes), accumulate((c for _, c in sizes), initial=0), strict=False))
    starts = placed.sparkSession.createDataFrame(before, "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    found = placed.withColumn("part", part).join(F.broadcast(starts), "part")  # a row for each partition
    return found.select(*[c for c in placed.columns if c != "at"], F.when(rank <= share * n["enough"] // 100, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", share: int = SHARE, seed: int = SEED, buckets: int = BUCKETS, longest: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, key, n_words, n_features, weight, score, rank)`` per row; ``rank`` is null for rows that aren't drawn."""
    s, t = (written(bucket_counts(x, c, longest, buckets)) for x, c in ((docs, text_col), (target, target_col)))
    got = gains(s, t, buckets).toArrow()  # a number for each bucket
    gain = np.zeros(buckets, dtype=np.int64)
    gain[got.column("bucket").to_numpy()] = got.column("gain").to_numpy()
    weighed = weights(docs, gain, id_col, text_col, longest)
    return ranked(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), share, least_words)


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their columns as they are; rows equal in id and text stay or go together."""
    chosen = resample(docs, target, id_col, text_col, **options).filter("rank is not null")
    keys = written(chosen.select(F.struct("doc_id", "key").alias("pair")).distinct())
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.struct(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("key")).alias("pair"))
    same = packed["pair.key"].eqNullSafe(keys["pair.key"]) & packed["pair.doc_id"].eqNullSafe(keys["pair.doc_id"])
    return packed.join(keys, same, "left_semi").select("row.*")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 bit by bit (least bit first), as DuckDB has no such function.
ORACLE_SQL = """
with texts as (select doc_id, text from documents),
tokens as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as w
  from texts),
target as (
  select list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as w
  from benchmark),
of_doc as (
  select doc_id, feature, count(*) as n
  from (select doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as feature from tokens)
  group by all),
of_target as (
  select feature, count(*) as n
  from (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as feature from target)
  group by all),
corpus as (select feature, sum(n)::bigint as n from of_doc group by all),
hashed as (
  select feature, xor(list_reduce(
    list_prepend(4294967295::bigint, flatten(list_transform(range(0, octet_length(encode(feature))), lambda i: list_transform(range(0, 8), lambda b: ('0x' || substr(hex(encode(feature)), 2 * i + 1, 2))::bigint >> b & 1)))),
    lambda c, bit: xor(c >> 1, 3988292384 * (xor(c, bit) & 1))), 4294967295) % 10000 as bucket
  from (select feature from corpus union select feature from of_target)),
s as (select bucket, sum(n)::double as s from corpus join hashed using (feature) group by all),
t as (select bucket, sum(n)::double as t from of_target join hashed using (feature) group by all),
gain as (
  select bucket, floor(1000.0 * ln((coalesce(t, 0) + 1) * ((select coalesce(sum(s), 0) from s) + 10000) / ((coalesce(s, 0) + 1) * ((select coalesce(sum(t), 0) from t) + 10000)))) as gain
  from s full join t using (bucket)),
weight as (
  select tokens.doc_id, any_value(len(w)) as n_words, coalesce(sum(n), 0)::bigint as n_features, coalesce(floor(sum(n * gain) / sum(n)), 0)::bigint as weight
  from tokens left join of_doc using (doc_id) left join hashed using (feature) left join gain using (bucket)
  group by all),
scored as (
  select *, weight + floor(-1000.0 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint + 0.5) / 4294967296.0)))::bigint as score
  from weight),
placed as (select doc_id, row_number() over (order by score desc, doc_id) as rank from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when rank <= floor(25 * (select count(*) from placed) / 100) then rank end as rank
from scored left join placed using (doc_id)
"""
