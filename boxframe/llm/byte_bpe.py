"""Byte-level BPE by dynamic programming over byte prefixes."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A space next to white space of any kind.
_LOOSE_SPACE = re.compile(r" \s|\s ")
#: Pieces whose ids a worker remembers before it starts anew; bounds its memory.
REMEMBERED = 200_000
#: Bytes of a piece's start whose encoding is remembered.
HEAD = 7


class Vocabulary:
    """Ranks of byte strings, and from which two tokens each is merged.

    A merge is made where two neighbours' joint bytes have the lowest rank,
    the leftmost first. Of the ways to cut a token in two, at most one is the
    pair that merging its bytes ends with.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Pairs looked at so far, and whether they stand apart.
        self.seen: dict[int, bool] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        #: Tokens that merging can make.
        self.made = {i for t, i in ranks.items() if len(t) == 1}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a in self.made and b in self.made and a != i != b and self.apart(a, b):
                    self.joined[a, b], self.parts[i] = i, (a, b)
                    self.made.add(i)
                    break
        self.usable = {t: i for t, i in ranks.items() if i in self.made}
        self.size = {i: len(t) for t, i in ranks.items()}

    def apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a then b gives just those two tokens.

        The merges that made a and b are undone from the last one back. At
        each moment the tokens at the border must not have a joint token that
        would have come first: one of lower rank than the next merge on
        either side, or of equal rank where the border lies left of it.
        """
        before = float("inf")
        while True:
            if self.joined.get((a, b), before) < before:
                return False
            made_a, made_b = (x if x in self.parts else -1 for x in (a, b))
            if made_a == made_b == -1:
                return True
            if made_a > made_b:
                before, a = a, self.parts[a][1]
            else:
                before, b = b + 1, self.parts[b][0]

    def remember(self, pair: int) -> bool:
        if len(self.seen) >= 2 * REMEMBERED:
            self.seen.clear()
        self.seen[pair] = apart = self.apart(pair >> 32, pair & 0xFFFFFFFF)
        return apart

    def extend(self, data: bytes, last: list[int], stop: int) -> None:
        """Add to ``last`` the last tokens of the prefixes of ``data`` up to ``stop`` bytes.

        Just one token is right at each end, so the shortest are tried first.
        """
        rank, seen, longest = self.usable.get, self.seen.get, self.longest
        for end in range(len(last), stop + 1):
            start = end
            for start in range(end - 1, max(end - longest, 0) - 1, -1):  # noqa: B020
                token = rank(data[start:end])
                if token is not None:
                    if not start:
                        break
                    pair = last[start] << 32 | token
                    apart = seen(pair)
                    if apart is None:
                        apart = self.remember(pair)
                    if apart:
                        break
            else:
                raise ValueError(f"no token ends at byte {end}")
            last.append(token)

    def read(self, last: list[int], end: int) -> list[int]:
        """The encoding of the first ``end`` bytes, from the last tokens of their prefixes."""
        found, length = [], self.size
        while end:
            found.append(last[end])
            end -= length[last[end]]
        return found[::-1]


class PrefixEncoder:
    """The ids of a growing or edited byte string.

    ``last[i]`` is the last token of the first i bytes' encoding; there is
    just one that ends there and stands apart from the last token before it.
    So bytes are appended without looking back further than the longest
    token, and any prefix can be read off at once.
    """

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.vocabulary.extend(self.data, self.last, len(self.data))

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` for bytes start to stop; returns for how many ends a token was looked up.

        Behind the edit, once the last tokens of as many ends in a row as the
        longest token has bytes are as before, so are all that follow.
        """
        old, tail = self.last, self.data[stop:]
        self.data, self.last = self.data[:start] + data + tail, self.last[: start + 1]
        moved, same, looked = len(data) - (stop - start), 0, 0
        for end in range(start + 1, len(self.data) + 1):
            if same >= self.vocabulary.longest:
                self.last += old[end - moved :]
                break
            self.vocabulary.extend(self.data, self.last, end)
            looked += 1
            behind = end - moved
            same = same + 1 if end > start + len(data) and old[behind] == self.last[-1] else 0
        return looked

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes (all, if None)."""
        return self.vocabulary.read(self.last, len(self.data) if end is None else end)


class Pieces(dict):
    """Ids of pieces of text, as little-endian unsigned 32-bit integers; remembers a bounded number."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        #: Last tokens of first bytes that many pieces share; the rest is appended to a copy.
        self.heads: dict[bytes, list[int]] = {}

    def _ids(self, data: bytes) -> list[int]:
        v, start = self.vocabulary, data[:HEAD]
        head = self.heads.get(start)
        if head is None:
            if len(self.heads) >= REMEMBERED // 4:
                self.heads.clear()
            head = self.heads[start] = [-1]
            v.extend(start, head, len(start))
        last = head.copy()
        v.extend(data, last, len(data))
        return v.read(last, len(data))

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        ids = [whole] if whole is not None else self._ids(data)
        packed = b"".join([i.to_bytes(4, "little") for i in ids])
        if len(piece) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = packed
        return packed


class Chunks(dict):
    """Ids of a space and the word behind it, with the marks that cling to it; remembers a bounded number."""

    def __init__(self, pieces: Pieces, pattern: str):
        super().__init__()
        self.pieces, self.cut = pieces, regex.compile(pattern)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.cut.findall(text)))

    def __missing__(self, chunk: str) -> bytes:
        packed = self.encode(" " + chunk)
        if len(chunk) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = packed
        return packed


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """A vocabulary of ranks, one a line: the token in base 64, a space, its rank."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


@lru_cache(maxsize=2)
def _chunks(path: str, pattern: str) -> Chunks:
    return Chunks(Pieces(load(path)), pattern)


@lru_cache(maxsize=2)
def _decoder(path: str) -> list[bytes]:
    known = load(path).bytes
    return [known.get(i, b"") for i in range(max(known) + 1)]


def encode(text: str | None, chunks: Chunks, at_spaces: bool = True) -> bytes:
    """Ids of a text, as little-endian unsigned 32-bit integers: each match of the pattern by itself.

    ``at_spaces`` says that the pattern begins a match at every space between
    two characters that aren't white space. Then texts in which all spaces
    are such are cut there first, and a word seen before needs no matching.
    """
    if not text:
        return b""
    if not at_spaces or text[0] == " " or text[-1] == " " or _LOOSE_SPACE.search(text):
        return chunks.encode(text)
    first, *rest = text.split(" ")
    return chunks.encode(first) + b"".join(map(chunks.__getitem__, rest))


def decode(ids: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, memoryview(ids).cast("I")))


def tokenize(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = True, at_spaces: bool = True) -> DataFrame:
    """The ``keep`` columns of ``df`` (all, if None) with ids, n_tokens, ids_sha256 and decoded_sha256.

    Whole texts are cut into the matches of ``pattern`` and each is encoded by
    prefix dynamic programming; a piece that is itself a token is that token.
    The ids are then decoded, and both the ids (as little-endian unsigned
    32-bit integers) and the decoded bytes get their SHA-256. ``path`` is the
    vocabulary's file, which every executor has; for ``at_spaces`` see ``encode``.

    Defined cases: null text is empty and has no ids; rows are treated by
    themselves, so repeated rows, ties and empty tables need no care; columns
    of ``df`` with the names added are replaced. ``with_ids`` leaves out ids.
    """
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        added.insert(0, T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = {f.name for f in added}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, tokens = _chunks(path, pattern), _decoder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = [encode(text.as_py(), chunks, at_spaces) for text in part.column(part.num_columns - 1)]
                counts = [len(x) // 4 for x in ids]
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                if with_ids:
                    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))))
                columns += [pa.array(counts, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(decode(x, tokens)).hexdigest() for x in ids])]
                yield pa.RecordBatch.from_arrays(columns, [*(f"c_{i}" for i in range(len(kept))), *(f.name for f in added)])

    chosen = df.select(*(F.col(c).alias(f"c_{i}") for i, c in enumerate(kept)), F.col(text_col).alias("__text"))
    out = chosen.mapInArrow(run, T.StructType([*chosen.schema.fields[:-1], *added]))
    return out.select(*(F.col(f"c_{i}").alias(c) for i, c in enumerate(kept)), *(f.name for f in added))
