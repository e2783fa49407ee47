"""Operator 13, alignment of two tokenizers' tokens of the same text.

Vocabulary A is byte-level BPE and gets the text after a space, vocabulary B is a SentencePiece model, which adds that
space itself; neither gives special tokens, whose strings in a text are plain text. Every byte has a label: none, A-end
(an A token ends with it), B-end, or both. A regular expression scans the labels of a text and takes spans up to each
both-label; the numbers of labels in a span are the numbers of A and B tokens of a group. Bytes between two labels
belong to one A and one B token, so each label is a link of two tokens whose byte ranges overlap.

No token of either vocabulary goes on from a letter into a space, and neither do merges. So a text is cut before
each space that follows another character than white space, both end tokens there, and what is made of such a
piece is remembered: frequent words are encoded and aligned once.

An id pair counts the documents that hold it linked. The pairs of each document are written to the shared folder once;
tasks sum them before the shuffle by pair. At most ``FEW_PAIRS`` counts, after they have been counted, are sent to all
tasks. Beyond that they go back by shuffle: to the dictionaries of blocks of documents, so a frequent pair travels
once a block, and then to the documents of each block. Either way the result is the same.

Null and empty texts, and those whose joined tokens aren't the text after a space, have no tokens: zeros and an
empty digest. Repeated rows count as documents each. Ties for a token's best pair are all best. A text of any length is
one row of a task. An empty table gives no rows. Ids may be of any type; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain, compress, pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe
from barloom.llm.common import Remembered, groups_of, sliced, table, written

#: Pairs whose counts are broadcast, of 13 bytes each.
FEW_PAIRS = 6_000_000
#: Documents of a block, as a power of two, and pairs that a task sums at once.
BLOCK_BITS, TASK_PAIRS = 10, 4_000_000
#: Pieces of texts that a worker remembers, in each of two generations.
KNOWN = 200_000
#: Fixed value: the pattern that cuts texts for byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Labels by (A ends) + 2 * (B ends), and spans up to a both-label.
LABELS = np.frombuffer(b".ab|", dtype=np.uint8)
SPAN = re.compile(rb"[^|]*\|")
#: Pieces of a text after a space: where white space of another kind stands before a space, and elsewhere.
CUT = re.compile(f"(?<=[^{bpe.SPACE}])(?= )")
PIECES = re.compile(r" +[^ ]+| +\Z")
MIXED = re.compile(f"[{bpe.SPACE.replace(' ', '')}] ")


def piece_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ByteTokens:
    """Vocabulary A: ids of whole texts, and the bytes of each id. Special tokens in a text are plain text.

    Where merges come in the order of the ids that they make, as usual, these are the ranks that tiktoken wants; other
    vocabularies are encoded as operator 9 does.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, special = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
        codec = bpe.Codec(path)
        codec.special = None
        self.bytes = codec.v.bytes
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if all(x < y for x, y in pairwise(made)) and len(made) + 256 + len(special & vocab.keys()) == len(vocab):
            import tiktoken

            ranks = {self.bytes[i]: i for s, i in vocab.items() if s not in special}
            self.encode = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            self.encode = lambda text: np.frombuffer(codec.encode([text])[0], dtype="<u4").tolist()


class Pieces:
    """Vocabulary B: ids of whole texts, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = map(sp.id_to_piece, range(sp.vocab_size()))
        self.bytes = [bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(names)]
        self.sp, self.space = sp, sp.piece_to_id("\u2581")
        #: Whether no piece has a space after another character.
        self.by_word = not any(b" " in b.lstrip(b" ") for b in self.bytes)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts that begin with a space, which the model adds itself."""
        return [ids or [self.space] for ids in self.sp.encode([t[1:] for t in texts], num_threads=1)]


#: What is remembered of a piece whose tokens aren't its bytes: a text with one counts less than no tokens.
UNFIT = (b"", b"", -(1 << 62))


def flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), dtype=np.int64)


class Aligner:
    """Both vocabularies, and what is made of a text's tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = ByteTokens(a_path), Pieces(b_path)
        self.a_size, self.b_size = (np.array([len(x) for x in v.bytes], dtype=np.int64) for v in (self.a, self.b))
        #: Each id with what follows it: within a group, at the end of its tokens of A, and of B.
        self.names = [b"%d%s" % (i, c) for n, last in ((len(self.a_size), b"|"), (len(self.b_size), b";")) for c in (b",", last) for i in range(n)]
        self.spans: dict[bytes, int] = {}
        self.known = Remembered(KNOWN)

    def cut(self, text: str) -> list[str]:
        """The pieces of a text after a space."""
        lead = f" {text}"
        if not self.b.by_word:
            return [lead]
        return CUT.split(lead) if MIXED.search(lead) else PIECES.findall(lead)

    def learn(self, pieces: list[str]) -> None:
        """What is made of pieces: their groups as text, their links and the number of A tokens; ``UNFIT`` where the joined tokens aren't the piece."""
        for i in range(0, len(pieces), 4_000):
            some = pieces[i : i + 4_000]
            tokens, raw = [list(map(self.a.encode, some)), self.b.encode(some)], [p.encode() for p in some]
            if not self._fits(tokens, raw):
                fit = [self._fits([[t[k]] for t in tokens], [r]) for k, r in enumerate(raw)]
                self.known.now.update((p, UNFIT) for p, ok in zip(some, fit, strict=True) if not ok)
                some, raw = list(compress(some, fit)), list(compress(raw, fit))
                tokens = [list(compress(t, fit)) for t in tokens]
                if not some:
                    continue
            a, b = map(flat, tokens)
            labels = self.labels(a, b)
            in_a, in_b = self.groups(labels)
            n_a, n_b = ([len(x) for x in t] for t in tokens)
            # in the text of the groups each token is one name, so a piece has as many as tokens
            names, links = list(map(self.names.__getitem__, self.named(a, b, in_a, in_b).tolist())), self.links(labels, a, b).tobytes()
            until_links = 8 * np.searchsorted(np.flatnonzero(labels), np.cumsum([len(r) for r in raw]))
            lo = at = 0
            for p, n, m, to in zip(some, n_a, n_b, until_links.tolist(), strict=True):
                self.known.now[p] = (b"".join(names[lo : lo + n + m]), links[at:to], n)
                lo, at = lo + n + m, to

    def _fits(self, tokens: list[list[list[int]]], raw: list[bytes]) -> bool:
        """Whether the joined tokens of all pieces are the pieces, by both vocabularies."""
        sizes = np.array([len(r) for r in raw])
        for v, size, t in zip((self.a, self.b), (self.a_size, self.b_size), tokens, strict=True):
            n, ids = np.array([len(x) for x in t]), flat(t)
            until = np.concatenate([[0], np.cumsum(size[ids])])[np.cumsum(n)]
            if (until != np.cumsum(sizes)).any() or b"".join(map(v.bytes.__getitem__, ids.tolist())) != b"".join(raw):
                return False
        return True

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, str, bytes | None]]:
        """Per text the numbers of A and B tokens, groups and links, the digest of its groups and its distinct linked pairs, packed."""
        cut = [self.cut(t) if t else [] for t in texts]
        self.learn(list(self.known.missing(set().union(*cut))))
        for c in cut:
            shown, links, n = zip(*map(self.known.now.__getitem__, c), strict=True) if c else ((), (), (-1,))
            n_a = sum(n)
            if n_a < 0:
                yield (0, 0, 0, 0, "", None)
                continue
            text, codes = b"".join(shown)[:-1], np.frombuffer(b"".join(links), dtype=np.int64)
            groups = text.count(b";") + 1
            # a group of p and q tokens has p + q - 1 links
            yield (n_a, len(codes) + groups - n_a, groups, len(codes), hashlib.sha256(text).hexdigest(), packed(*np.unique(codes, return_counts=True)))

    def labels(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The label of each byte, as a number: 1 where an A token ends, 2 where a B token does, 3 where both do."""
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        out = np.zeros(a_ends[-1], dtype=np.uint8)
        out[a_ends - 1] = 1
        out[b_ends - 1] |= 2
        return out

    def groups(self, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of A and of B tokens in each group: those of the labels in each span up to a both-label."""
        spans = SPAN.findall(LABELS[labels].tobytes())
        if len(self.spans) > KNOWN:
            self.spans.clear()
        for s in set(spans).difference(self.spans):
            self.spans[s] = (s.count(b"a") + 1) << 32 | s.count(b"b") + 1
        n = np.fromiter(map(self.spans.__getitem__, spans), dtype=np.int64, count=len(spans))
        return n >> 32, n & 0xFFFFFFFF

    def named(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> np.ndarray:
        """Places in ``names`` that spell the groups as ``a1,a2|b1;a3|b2,b3;``: of each group its A tokens, then its B tokens."""
        last_a, last_b = np.cumsum(in_a) - 1, np.cumsum(in_b) - 1
        of_a, of_b = a.copy(), b + 2 * len(self.a_size)
        of_a[last_a] += len(self.a_size)
        of_b[last_b] += len(self.b_size)
        out = np.empty(len(a) + len(b), dtype=np.int64)
        out[np.arange(len(a)) + np.repeat(last_b + 1 - in_b, in_a)] = of_a
        out[np.arange(len(b)) + np.repeat(last_a + 1, in_b)] = of_b
        return out

    def links(self, labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id pairs of all links, as ``a << 32 | b``: each label ends a run of bytes that one A and one B token share."""
        at = labels[labels > 0]
        of_a, of_b = at & 1, at >> 1
        return a[np.cumsum(of_a, dtype=np.int64) - of_a] << 32 | b[np.cumsum(of_b, dtype=np.int64) - of_b]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str | None, b_path: str | None) -> Aligner:
    """One aligner for each two vocabularies in a worker."""
    paths = (a_path or bpe.byte_bpe_path(), b_path or piece_bpe_path())
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


def packed(codes: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending pairs and their numbers of links: differences of A ids, B ids and numbers one after the other, compressed."""
    a, b = codes >> 32, codes & 0xFFFFFFFF
    return zstandard.compress(len(codes).to_bytes(8, "little") + b"".join(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in (np.diff(a, prepend=0), b, n)), 3)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(data)
    k = int.from_bytes(raw[:8], "little")
    a, b, n = (np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * k, 8 + 4 * k * i).reshape(4, k).T).view("<u4").ravel().astype(np.int64) for i in range(3))
    return np.cumsum(a) << 32 | b, n


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs)`` per row; ``pairs`` holds the distinct linked id pairs, see :func:`unpacked`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = aligner(a_path, b_path)
        for b in sliced(batches, 256):
            rows = [r for g in groups_of(x.as_py() or "" for x in b.column(1)) for r in t.align(g)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in KINDS]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, KINDS.values(), strict=True))], ["doc_id", *KINDS])

    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary")


KINDS = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "pairs": pa.binary()}


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(a, b, n, best)``: in how many documents each id pair is linked, and whether no other pair of its A id is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, held, size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), [], 0

        def summed() -> None:
            nonlocal codes, n, held, size
            every, back = np.unique(np.concatenate([codes, *held]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n, np.ones(len(back) - len(n), dtype=np.int64)]), len(every)).astype(np.int64)
            codes, held, size = every, [], 0

        def batches_of() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(codes), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in ((codes >> 32).astype(np.int32), (codes & 0xFFFFFFFF).astype(np.int32), n)], ["a", "b", "n"])

        for b in batches:
            for x in b.column(0):
                if x.is_valid:
                    held.append(unpacked(x.as_py())[0])
                    size += len(held[-1])
                if size >= TASK_PAIRS:
                    summed()
                    if len(codes) >= TASK_PAIRS:
                        yield from batches_of()
                        codes, n = codes[:0], n[:0]
        summed()
        yield from batches_of()

    counts = written(aligned.select("pairs").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A at most
    return counts.join(F.broadcast(most), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _totals(pairs: bytes | None, codes: np.ndarray, n: np.ndarray, best: np.ndarray) -> tuple[int, int]:
    """``(n_best, count_sum)`` of a document's pairs, all of which are among the ascending ``codes``."""
    if pairs is None:
        return 0, 0
    mine, links = unpacked(pairs)
    at = np.searchsorted(codes, mine)
    return int(links[best[at]].sum()), int((links * n[at]).sum())


def with_counts(aligned: DataFrame, counts: DataFrame, few: int | None = None) -> DataFrame:
    """The rows of a written table of :func:`align` with ``n_best`` and ``count_sum``, without ``pairs``; ``counts`` is a written table of :func:`pair_counts`."""
    kept = [c for c in aligned.columns if c not in ("pairs", "block")]
    schema = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in kept) + ", n_best long, count_sum long"

    def totalled(b: pa.Table | pa.RecordBatch, codes: np.ndarray, n: np.ndarray, best: np.ndarray) -> list[pa.Array]:
        got = [_totals(x.as_py(), codes, n, best) for x in b.column("pairs")]
        return [*(b.column(c) for c in kept), *(pa.array([x[i] for x in got], pa.int64()) for i in (0, 1))]

    if counts.count() <= (FEW_PAIRS if few is None else few):
        got = counts.select(F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b")).alias("code"), F.col("n"), "best").orderBy("code").toArrow()
        n = got.column("n").to_numpy()
        n = n.astype(np.int32) if n.max(initial=0) < 1 << 31 else n
        shared = aligned.sparkSession.sparkContext.broadcast((got.column("code").to_numpy(), n, got.column("best").to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                yield pa.RecordBatch.from_arrays(totalled(b, *shared.value), [*kept, "n_best", "count_sum"])

        return aligned.mapInArrow(run, schema)

    def dictionaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            block = b.column(0).to_numpy()
            for k in np.unique(block).tolist():
                found = [unpacked(x.as_py())[0] for x in b.column(1).filter(pa.array(block == k)) if x.is_valid]
                codes = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *found]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), k)), *(pa.array(x.astype(np.int32)) for x in (codes >> 32, codes & 0xFFFFFFFF))], ["block", "a", "b"])

    def of_block(docs: pa.Table, found: pa.Table) -> pa.Table:
        codes = found.column("a").to_numpy().astype(np.int64) << 32 | found.column("b").to_numpy()
        codes, first = np.unique(codes, return_index=True)
        return pa.table(totalled(docs, codes, found.column("n").to_numpy()[first], found.column("best").to_numpy()[first]), [*kept, "n_best", "count_sum"])

    wanted = aligned.select("block", "pairs").mapInArrow(dictionaries, "block long, a int, b int")
    found = wanted.join(counts, ["a", "b"])
    return aligned.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(of_block, schema)


def alignments(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", few: int | None = None) -> DataFrame:
    """Per row ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum``: its groups and links, and how common these are in the corpus."""
    aligned = align(docs, a_path, b_path, id_col, text_col)
    aligned = written(aligned.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)))
    return with_counts(aligned, written(pair_counts(aligned)), few)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"))
