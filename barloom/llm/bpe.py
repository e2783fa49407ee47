"""Operator 9, byte-level BPE encoding and decoding by speculation and verification.

A text is cut into words as the vocabulary's own pattern does. For each distinct word:

1. *Speculate*: greedy longest match over the vocabulary proposes tokens.
2. *Verify*: a sequence of tokens is what merging would give exactly when every adjacent pair is
   compatible, i.e. when no merge across the border fires before the pieces on both sides of it
   have been used up. All distinct pairs of a batch are tested at once in numpy, by walking down the
   right edge of the left token's merge tree and the left edge of the right one's.
3. Only words with a failing pair are merged exactly, by rank.

Results are kept per worker in a bounded table of chunks, so common words cost one look-up.
Decoding joins the bytes of the tokens. Null texts are empty: no tokens, empty text. The text of a
special token in a document becomes that token, as the tokenizers library does. Repeated rows are encoded
each, ties of rank go to the leftmost pair. A text of any length is one row of a task, and a word of any
length takes n log n. An empty table gives no rows. Ids may be of any type; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import Remembered, groups_of, sliced, table

#: Entries of each worker's tables of known chunks and words, in each of two generations.
KNOWN = 200_000
#: Unicode white space, the pattern that splits text before merging (for ASCII text) and what starts a chunk.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^{SPACE}A-Za-z0-9]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Without these, every single space starts a chunk.
UNEVEN = re.compile(f" [{SPACE}]| \\Z")


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of the vocabulary file stands for: printable bytes are themselves, the others follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and their trees, from a vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _bytes_of_letters()
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * n
        for s, i in ids.items():
            self.bytes[i] = s.encode() if s in self.special else bytes(letters[c] for c in s)
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank_of: dict[int, int] = {}  # of pair a, b: a * n + b
        self.token_of: dict[int, int] = {}  # by rank
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        never = np.iinfo(np.int64).max
        self.made = np.full(n, never)  # the rank of the merge that makes a token
        self.made[[i for i, b in enumerate(self.bytes) if len(b) == 1]] = -1
        for r, (a, b) in enumerate(merges):
            pair, t = (ids[a], ids[b]), ids[a + b]
            self.rank_of.setdefault(pair[0] * n + pair[1], r)
            self.token_of[r] = t
            if self.made[t] == never:
                self.made[t], self.left[t], self.right[t] = r, *pair
        self.byte_id = {b[0]: i for i, b in enumerate(self.bytes) if len(b) == 1 and i not in self.special.values()}
        codes = np.array(list(self.rank_of), dtype=np.int64)
        order = np.argsort(codes)
        self.n, self.codes, self.ranks = n, codes[order], np.array(list(self.rank_of.values()))[order]
        whole = np.nonzero(self.left >= 0)[0]
        sound = np.ones(n, dtype=bool)
        sound[whole] = self._compatible(self.left[whole], self.right[whole], within=self.made[whole])
        self.ids = {b: i for i, b in enumerate(self.bytes) if sound[i] and i not in self.special.values() and self.made[i] < never}
        self.longest: dict[bytes, int] = {}  # by the first three bytes
        for b in self.ids:
            if len(b) > 2:
                self.longest[b[:3]] = max(len(b), self.longest.get(b[:3], 0))

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, -2 where there is none."""
        code = a.astype(np.int64) * self.n + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], -2)

    def _compatible(self, a: np.ndarray, b: np.ndarray, within: np.ndarray | None = None) -> np.ndarray:
        """Whether merging ``a + b`` never crosses their border, or with ``within`` not before that rank.

        A piece on the border exists until its parent is made. A merge across fires if it comes before
        both parents; of equal pairs the left one goes first.
        """
        never = np.iinfo(np.int64).max
        ok = np.ones(len(a), dtype=bool)
        end = np.full(len(a), never) if within is None else within
        r, r_until = a.copy(), end.copy()
        live = np.arange(len(a))
        while len(live):
            l, l_until, some = b[live], end[live], live
            while len(some):
                m = self._merge_rank(r[some], l)
                fires = np.maximum(m, np.maximum(self.made[r[some]], self.made[l]))
                ok[some[(m >= 0) & (fires < r_until[some]) & ((fires < l_until) | (fires == l_until) & (l_until != end[some]))]] = False
                down = (self.left[l] >= 0) & ok[some]
                l_until, some, l = self.made[l[down]], some[down], self.left[l[down]]
            live = live[(self.right[r[live]] >= 0) & ok[live]]
            r_until[live] = self.made[r[live]]
            r[live] = self.right[r[live]]
        return ok

    def greedy(self, word: bytes) -> list[int]:
        ids, longest = self.ids, self.longest
        if word in ids:
            return [ids[word]]
        out, i, n = [], 0, len(word)
        while i < n:
            for j in range(min(n, i + longest.get(word[i : i + 3], 2)), i, -1):
                t = ids.get(word[i:j])
                if t is not None:
                    out.append(t)
                    i = j
                    break
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merging by rank, leftmost first: a heap of pairs over a linked list, so that a word of any length takes n log n."""
        n, rank, token_of = self.n, self.rank_of, self.token_of
        t = [self.byte_id[b] for b in word]
        end = len(t)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(r, i, t[i], t[i + 1]) for i in range(end - 1) if (r := rank.get(t[i] * n + t[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i, a, b = heappop(heap)
            j = after[i]
            if t[i] != a or j >= end or t[j] != b:  # one of the two has been merged since
                continue
            t[i], t[j] = token_of[r], -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (r := rank.get(t[i] * n + t[k])) is not None:
                    heappush(heap, (r, i, t[i], t[k]))
            if (h := before[i]) >= 0 and (r := rank.get(t[h] * n + t[i])) is not None:
                heappush(heap, (r, h, t[h], t[i]))
        return [x for x in t if x >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of each word: greedy proposals, one vectorised check of all pairs, exact merging where it fails."""
        proposed = [self.greedy(w) for w in words]
        sizes = np.fromiter(map(len, proposed), dtype=np.int64, count=len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), dtype=np.int64, count=int(sizes.sum()))
        word_of = np.repeat(np.arange(len(words)), sizes)
        pair = np.nonzero(word_of[:-1] == word_of[1:])[0] if len(flat) > 1 else np.zeros(0, dtype=np.int64)
        codes, back = np.unique(flat[pair] * self.n + flat[pair + 1], return_inverse=True)
        ok = self._compatible(codes // self.n, codes % self.n)
        for i in np.unique(word_of[pair[~ok[back]]]):
            proposed[i] = self.exact(words[i])
        return proposed


class Codec:
    """Encodes and decodes whole texts; remembers chunks it has met."""

    def __init__(self, path: str) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        self.v = Vocabulary(path)
        self.letters = _bytes_of_letters()
        self.split_any = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.after_space, self.chunks, self.words = (Remembered(KNOWN) for _ in range(3))
        self.special = re.compile("|".join(map(re.escape, sorted(self.v.special, key=len, reverse=True)))) if self.v.special else None

    def _words_of(self, chunk: str) -> list[bytes]:
        if chunk.isascii():
            return [p.encode() for p in PIECES.findall(chunk)]
        return [bytes(map(self.letters.__getitem__, p)) for p, _ in self.split_any(chunk)]

    def _learn(self, chunks: set[str], after_space: set[str]) -> None:
        cut = [(self.chunks, c, self._words_of(c)) for c in chunks] + [(self.after_space, c, self._words_of(f" {c}")) for c in after_space]
        new = list(self.words.missing({w for *_, ws in cut for w in ws}))
        known = self.words.now
        for w, t in zip(new, self.v.encode_words(new), strict=True):
            known[w] = np.array(t, dtype="<u4").tobytes()
        for table, c, ws in cut:
            table.now[c] = b"".join(map(known.__getitem__, ws))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        parts: list[list] = []  # per text: ids of special tokens, lists of chunks, or (first, after a space)
        for text in texts:
            out: list = []
            at = 0
            for m in self.special.finditer(text) if self.special and "<" in text else ():
                out += [self._cut(text[at : m.start()]), self.v.special[m[0]]]
                at = m.end()
            out.append(self._cut(text[at:]))
            parts.append(out)
        chunks, after = self._needed(parts)
        self._learn(self.chunks.missing(chunks), self.after_space.missing(after))
        return [b"".join(map(self._ids, out)) for out in parts]

    @staticmethod
    def _needed(parts: list[list]) -> tuple[set[str], set[str]]:
        """Chunks of all parts, and those after a space, without it."""
        chunks: set[str] = set()
        after: set[str] = set()
        for p in (p for out in parts for p in out):
            if isinstance(p, tuple):
                chunks.add(p[0])
                after.update(p[1])
            elif isinstance(p, list):
                for c in set(p):
                    (after if c[0] == " " else chunks).add(c[1:] if c[0] == " " else c)
        chunks.discard("")
        return chunks, after

    @staticmethod
    def _cut(text: str) -> list | tuple:
        if UNEVEN.search(text) or text[:1] == " ":
            return CHUNKS.findall(text)
        first, *rest = text.split(" ")
        return (first, rest)

    def _ids(self, part: list | tuple | int) -> bytes:
        if isinstance(part, int):
            return part.to_bytes(4, "little")
        if isinstance(part, list):
            return b"".join([self.after_space.now[c[1:]] if c[0] == " " else self.chunks.now[c] for c in part])
        first = self._first(part[0])
        return first + b"".join(map(self.after_space.now.__getitem__, part[1]))

    def _first(self, chunk: str) -> bytes:
        """The text before the first space can hold other white space: it is a chunk of its own."""
        return self.chunks.now[chunk] if chunk else b""

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.v.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each vocabulary in a worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` per row; ``ids`` is binary, little-endian unsigned 32-bit integers."""
    return _mapped(docs, path, id_col, text_col, "ids binary", lambda c, ids: [ids], [pa.binary()])


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row, the text decoded from the ids."""

    def row(c: Codec, ids: bytes) -> list:
        return [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()]

    return _mapped(docs, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", row, [pa.int64(), pa.string(), pa.string()])


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` per row of :func:`encode`; null ids give an empty text."""
    vocabulary = path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary or byte_bpe_path())
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x.as_py() or b"") for x in b.column(1)], pa.string())], ["doc_id", "text"])

    kind = encoded.select(id_col).dtypes[0][1]
    return encoded.select(id_col, ids_col).mapInArrow(run, f"doc_id {kind}, text string")


def _mapped(docs: DataFrame, path: str | None, id_col: str, text_col: str, schema: str, row, kinds: list) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or byte_bpe_path())
        for b in sliced(batches):
            rows = [row(c, ids) for g in groups_of(x.as_py() or "" for x in b.column(1)) for ids in c.encode(g)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(v), k) for v, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, {schema}")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
