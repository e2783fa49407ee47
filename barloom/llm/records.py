"""Operator 4, token ids in length-delimited binary records with an offset index beside each file.

A record is framed as: unsigned 64-bit length of the payload, masked CRC-32 of these eight bytes,
payload, masked CRC-32 of the payload (all little-endian; a mask rotates the checksum by 15 bits and
adds a constant, so that checksums of data that holds checksums stay sound). The payload is a
serialized sequence: document id, flags (1: the id is null; 2: ids take 4 bytes, else 2), number of
ids, ids. ``*.idx`` holds one fixed-size entry for each record of its ``*.rec``, so a shuffled reader
can seek to any record without reading the ones before.

Documents are dealt by ranges of their ids, and a file starts anew every ``FILE_TOKENS`` ids, so files
are bounded and their names ascend with the ids. A task writes under a name of its own and renames at
the end: a retried task after a lost executor replaces its files by equal ones.

The list of files is a table: where a file starts comes from sums by range, and the driver holds none of it.

Null and empty texts give the end id alone. Rows without an id come first, dealt to ranges of their own by a
checksum. Rows that share an id, repeated rows too, are kept, in the order of their ids' bytes, in one range. A
text of any length is one record. An empty table gives no files and no rows. Ids must be whole numbers; other
columns, whatever their names, are not read. Files go to any store that ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.common import Remembered, MAX_RANGES, groups_of, range_bounds, range_of, shared_dir, sliced, table, written

FILE_TOKENS = 4_000_000
ROWS_PER_RANGE = 4_096
#: A task reads several files, one after the other, where there are more.
MAX_TASKS = 20_000
#: Words that a worker remembers, in each of two generations.
KNOWN = 400_000
#: Fixed value: added to the rotated checksum.
MASK = 0xA282EAD8
ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("n_tokens", "<u4"), ("flags", "<u4")])
HEAD = np.dtype([("doc_id", "<i8"), ("flags", "<u4"), ("n_tokens", "<u4")])

#: The word pattern of the vocabulary for lower-cased text of ASCII and Latin-1 letters, and what is beyond that.
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-z0-9ß-öø-ÿ]+")
BEYOND = re.compile("[^\\x00-\\x1b\\x20-\\x7eÀ-ÖØ-öø-ÿ]")
#: str.split() cuts at these, the vocabulary's pattern doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Words that the library gets at once.
TOGETHER = 100


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = len(payload).to_bytes(8, "little")
    return b"".join((size, masked(size).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def serialize(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    head = np.array([(doc_id or 0, (doc_id is None) + 2 * wide, len(ids))], dtype=HEAD)
    return head.tobytes() + ids.astype("<u4" if wide else "<u2").tobytes()


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    head = np.frombuffer(payload, dtype=HEAD, count=1)[0]
    ids = np.frombuffer(payload, dtype="<u4" if head["flags"] & 2 else "<u2", offset=HEAD.itemsize)
    if len(ids) != head["n_tokens"]:
        raise ValueError("a record's length doesn't fit its number of ids")
    return None if head["flags"] & 1 else int(head["doc_id"]), ids.astype("<u4")


def read_frame(f) -> bytes | None:
    """The next payload of an open file, None at its end; raises ValueError where a checksum or a length doesn't hold."""
    start = f.read(12)
    if not start:
        return None
    if len(start) < 12 or masked(start[:8]) != int.from_bytes(start[8:], "little"):
        raise ValueError("a record's length is damaged")
    size = int.from_bytes(start[:8], "little")
    body = f.read(size + 4)
    if len(body) < size + 4 or masked(body[:size]) != int.from_bytes(body[size:], "little"):
        raise ValueError("a record is damaged")
    return body[:size]


class Encoder:
    """Whole texts by the tokenizers library; what it gave for a word is remembered.

    The vocabulary drops white space and starts anew at it, so a text's ids are those of its words in
    order, each word ending in a token that says so. Plain texts are cut as its pattern does; of others
    the chunks between white space are, and chunks with other letters or special tokens go to the
    library as they are. Texts with separators that Python takes for white space go there whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        self.special = [t.content for t in self.t.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.t.get_vocab_size() + 1, dtype=bool)
        for token, i in self.t.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.words = Remembered(KNOWN)
        #: Bytes that a token id takes at least.
        self.wide = 2 if max(self.t.get_vocab(with_added_tokens=True).values()) <= 0xFFFF else 4

    def _library(self, texts: list[str]) -> Iterator[bytes]:
        for i in range(0, len(texts), 1_000):
            for e in self.t.encode_batch_fast(texts[i : i + 1_000], add_special_tokens=False):
                yield np.array(e.ids, dtype="<u4").tobytes()

    def _library_words(self, words: list[str]) -> Iterator[bytes]:
        """Words of the pattern, many in one text: each ends with a token of a word's end."""
        together = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for group, got in zip(together, self._library([" ".join(g) for g in together]), strict=True):
            last = np.nonzero(self.ends[np.frombuffer(got, "<u4")])[0]
            if len(last) != len(group) or 4 * (last[-1] + 1) != len(got):
                yield from self._library(group)
                continue
            at = 0
            for e in ((last + 1) * 4).tolist():
                yield got[at:e]
                at = e

    def _plain(self, text: str) -> bool:
        return not BEYOND.search(text) and not any(s in text for s in self.special)

    def _cut(self, text: str) -> list[str] | None:
        """Words of the pattern, and chunks for the library with a space before each; None: the library takes the text whole."""
        if self._plain(text):
            return PLAIN_WORDS.findall(text.lower())
        if SEPARATORS.search(text):
            return None
        return [w for c in text.split() for w in (PLAIN_WORDS.findall(c.lower()) if self._plain(c) else (f" {c}",))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        cut = [self._cut(t) for t in texts]
        need = set().union(*(c for c in cut if c))
        missing, known = self.words.missing(need), self.words.now
        words, chunks = [w for w in missing if w[0] != " "], [w for w in missing if w[0] == " "]
        known.update(zip(words, self._library_words(words), strict=True))
        known.update(zip(chunks, self._library(chunks), strict=True))
        whole = iter(self._library([t for t, c in zip(texts, cut, strict=True) if c is None]))
        return [next(whole) if c is None else b"".join(map(known.__getitem__, c)) for c in cut]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Files:
    """Writes the records of one range into files of bounded size, each with its index."""

    def __init__(self, url: str, part: int) -> None:
        self.store, self.dir = fs.FileSystem.from_uri(url)
        self.part, self.k, self.n, self.done = part, 0, 0, []
        self.mark = uuid.uuid4().hex
        self.f, self.entries = None, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.f is None:
            self.name = f"part-{self.part:06d}-{self.k:06d}"
            self.f, self.at, self.n, self.entries = self.store.open_output_stream(f"{self.dir}/_{self.mark}-{self.name}.rec"), 0, 0, []
        framed = frame(serialize(doc_id, ids))
        self.f.write(framed)
        self.entries.append((doc_id or 0, self.at, len(framed), len(ids), int(doc_id is None)))
        self.at += len(framed)
        self.n += len(ids)
        if self.n >= FILE_TOKENS:
            self.close()

    def close(self) -> None:
        if self.f is None:
            return
        self.f.close()
        with self.store.open_output_stream(f"{self.dir}/_{self.mark}-{self.name}.idx") as i:
            i.write(np.array(self.entries, dtype=ENTRY).tobytes())
        for kind in ("idx", "rec"):
            self.store.move(f"{self.dir}/_{self.mark}-{self.name}.{kind}", f"{self.dir}/{self.name}.{kind}")
        self.done.append((self.part, self.k, self.name, len(self.entries), self.n, self.at))
        self.f, self.k = None, self.k + 1

    def closed(self) -> pa.RecordBatch:
        """The range's files, as rows."""
        self.close()
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*self.done, strict=True), kinds, strict=True)], [x.split()[0] for x in FILES.split(", ")])


def write(docs: DataFrame, url: str, path: str | None = None, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes ``docs`` and writes files below ``url``, ids ascending; returns a written table with a row a file.

    Per file: ``part, k`` (its order), name, records, tokens, bytes, and start, the number of tokens in all files before.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    n = ids.agg(F.count("*").alias("rows"), F.count("doc_id").alias("named")).first()
    nameless = min(MAX_RANGES, -(-(n["rows"] - n["named"]) // ROWS_PER_RANGE))  # ranges of rows without an id
    bounds = range_bounds(ids, "doc_id", ROWS_PER_RANGE)
    store, folder = fs.FileSystem.from_uri(url)
    store.create_dir(folder, recursive=True)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path or word_bpe_path())
        for b in sliced(batches):
            got = [x + end for g in groups_of(t.as_py() or "" for t in b.column(1)) for x in e.encode(g)]
            part = nameless + range_of(bounds, b.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            for i in np.flatnonzero(b.column(0).is_null().to_numpy(zero_copy_only=False)):
                part[i] = zlib.crc32(got[i]) % nameless
            narrow = [np.frombuffer(x, "<u4") for x in got]
            small = [len(x) == 0 or x.max() <= 0xFFFF for x in narrow]
            packed = [x.astype("<u2").tobytes() if s else x.tobytes() for x, s in zip(narrow, small, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column(0), pa.array(small), pa.array(packed, pa.binary())], ["part", "doc_id", "small", "ids"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: _Files | None = None
        for b in sliced(batches):
            for part, doc_id, small, x in zip(*(c for c in b.columns), strict=True):
                part = part.as_py()
                if out is None or out.part != part:
                    if out is not None:
                        yield out.closed()
                    out = _Files(url, part)
                out.add(doc_id.as_py(), np.frombuffer(x.as_py(), "<u2" if small.as_py() else "<u4").astype("<u4"))
        if out is not None:
            yield out.closed()

    encoded = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "part int, doc_id long, small boolean, ids binary")
    dealt = encoded.repartitionById(nameless + len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "ids")
    files = written(dealt.mapInArrow(save, FILES))
    by_part = files.groupBy("part").agg(F.sum("tokens").alias("tokens"))  # at most 2 * MAX_RANGES rows
    before = by_part.select("part", (F.sum("tokens").over(W.orderBy("part")) - F.col("tokens")).alias("before"))
    within = F.sum("tokens").over(W.partitionBy("part").orderBy("k")) - F.col("tokens")
    return written(files.withColumn("within", within).join(F.broadcast(before), "part").select("part", "k", "name", "records", "tokens", "bytes", (F.col("before") + F.col("within")).alias("start")))


FILES = "part int, k int, name string, records long, tokens long, bytes long"


def _tasks(files: DataFrame) -> int:
    return max(1, min(MAX_TASKS, files.count()))


def read(spark: SparkSession, url: str, files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every record, read in file order; ``ids`` is binary, 4 bytes an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(url)
        for b in batches:
            for name, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = []
                with store.open_input_stream(f"{folder}/{name}.rec") as f:
                    while (payload := read_frame(f)) is not None:
                        doc_id, ids = parse(payload)
                        rows.append((doc_id, start, len(ids), ids.tobytes()))
                        start += len(ids)
                        if len(rows) == 500:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    return files.select("name", "start").repartition(_tasks(files), "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], list(names))


def read_shuffled(spark: SparkSession, url: str, files: DataFrame, seed: int, parts: int | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every record once, dealt at random: seeks by the offset index."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(url)
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_stream(f"{folder}/{name}.idx") as f:
                    e = np.frombuffer(f.read(), dtype=ENTRY)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(e)), pa.array(e["offset"].astype(np.int64))], ["name", "offset"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(url)
        open_: dict[str, object] = {}
        for b in batches:
            rows = []
            for name, offset in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name not in open_:
                    if len(open_) == 64:
                        open_.pop(next(iter(open_))).close()
                    open_[name] = store.open_input_file(f"{folder}/{name}.rec")
                open_[name].seek(offset)
                doc_id, ids = parse(read_frame(open_[name]))
                rows.append((doc_id, 0, len(ids), ids.tobytes()))
                if len(rows) == 500:
                    yield _rows(rows)
                    rows = []
            yield _rows(rows)

    at = files.select("name").repartition(_tasks(files), "name").mapInArrow(index, "name string, offset long")
    at = at.withColumn("__r", F.xxhash64(F.lit(seed), "name", "offset"))
    at = at.repartition(parts or _tasks(files), "__r").sortWithinPartitions("__r").select("name", "offset")
    return at.mapInArrow(fetch, "doc_id long, start long, n_tokens long, ids binary").drop("start")


def op4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = shared_dir(spark)
    files = write(table(spark, sf_dir, "documents"), url)
    return read(spark, url, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
