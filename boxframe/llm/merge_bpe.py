"""BPE by a priority queue of merge ranks over a doubly linked list of symbols."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxframe.llm.byte_bpe import Chunks, decode
from boxframe.llm.byte_bpe import encode as in_chunks

#: Pieces, and words with what clings to them, whose ids a worker remembers before it starts anew; bounds its memory.
REMEMBERED = 400_000
#: Fixed value: how byte-level vocabularies cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary's strings, and that byte.

    Printable bytes of Latin-1 stand for themselves, the others in turn for
    the code points from 256 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted({*range(256)} - {*printable})
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """A vocabulary of strings and the order in which pairs of them are merged, as a tokenizer's JSON file has them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], spec.get("added_tokens") or []
        cut, read = spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
        plain = cut.get("type") == read.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec.get("normalizer")
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "fuse_unk", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or not plain or odd:
            raise ValueError(f"{path} is no plain byte-level BPE: {odd}")
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has added tokens that take in what's beside them")
        ids = model["vocab"] | {t["content"]: t["id"] for t in added}
        letter = byte_letters()
        #: The token of each single byte.
        self.start = [-1] * 256
        for c, b in letter.items():
            self.start[b] = ids.get(c, -1)
        #: The rank of a pair of tokens (the first's id in the upper bits), and the token that each rank makes.
        self.rank: dict[int, int] = {}
        self.makes: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[ids[a] << 32 | ids[b]] = rank
            self.makes.append(ids[a + b])
        #: The bytes of each token's string; what isn't all byte letters stands for itself.
        self.bytes = [b""] * (max(ids.values()) + 1)
        for s, i in ids.items():
            self.bytes[i] = bytes(letter[c] for c in s) if all(c in letter for c in s) else s.encode()
        #: Added tokens, which a text's merging never crosses; of several that start at one place the longest counts.
        self.added = {t["content"]: t["id"] for t in added}
        self.special = re.compile("|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True))) if added else None

    def merge(self, data: bytes) -> list[int]:
        """The tokens of a piece: the pair of lowest rank is merged first, of equal ones the leftmost.

        Symbols are a doubly linked list by place. The queue holds a rank and
        a place in one number; an entry is stale, and skipped, if the pair at
        its place has another rank by then.
        """
        rank, makes = self.rank.get, self.makes
        symbols = [self.start[b] for b in data]
        n = len(symbols)
        queue = [r << 32 | i for i in range(n - 1) if (r := rank(symbols[i] << 32 | symbols[i + 1])) is not None]
        if not queue:
            return symbols
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heapq.heappop(queue)
            at = entry & 0xFFFFFFFF
            own, right = symbols[at], after[at]
            if own < 0 or right == n or rank(own << 32 | symbols[right]) != entry >> 32:
                continue
            symbols[at] = own = makes[entry >> 32]
            symbols[right] = -1
            after[at] = right = after[right]
            if right < n:
                before[right] = at
                r = rank(own << 32 | symbols[right])
                if r is not None:
                    heapq.heappush(queue, r << 32 | at)
            left = before[at]
            if left >= 0:
                r = rank(symbols[left] << 32 | own)
                if r is not None:
                    heapq.heappush(queue, r << 32 | left)
        return [s for s in symbols if s >= 0]


class Merged(dict):
    """Ids of pieces of text, as little-endian unsigned 32-bit integers; remembers a bounded number."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> bytes:
        packed = array("I", self.merges.merge(piece.encode())).tobytes()
        if len(piece) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = packed
        return packed


class MergedChunks(Chunks):
    """Ids of a space and the word behind it; remembers a bounded number."""

    def __missing__(self, chunk: str) -> bytes:
        packed = self.encode(" " + chunk)
        if len(chunk) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = packed
        return packed


@lru_cache(maxsize=2)
def load(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=2)
def chunks_of(path: str) -> Chunks:
    return MergedChunks(Merged(load(path)), PATTERN)


def encode(text: str | None, merges: Merges, chunks: Chunks) -> bytes:
    """Ids of a text, as little-endian unsigned 32-bit integers; strings of added tokens in it are those tokens."""
    if not text:
        return b""
    if merges.special is None or not (found := list(merges.special.finditer(text))):
        return in_chunks(text, chunks)
    parts, end = [], 0
    for m in found:
        parts += [in_chunks(text[end : m.start()], chunks), merges.added[m[0]].to_bytes(4, "little")]
        end = m.end()
    return b"".join([*parts, in_chunks(text[end:], chunks)])


def decoded(ids: bytes, merges: Merges) -> bytes:
    """The text of ids, in UTF-8: vocabulary strings one after the other; what isn't UTF-8 becomes replacement characters."""
    return decode(ids, merges.bytes).decode("utf-8", "replace").encode()


def tokenize(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """The ``keep`` columns of ``df`` (all, if None) with ids, n_tokens, ids_sha256 and decoded_sha256.

    Whole texts are cut into pieces, and each piece's bytes are merged with a
    priority queue over a linked list; strings of added tokens in a text are
    those tokens. The ids are decoded again, and both the ids (as
    little-endian unsigned 32-bit integers) and the decoded text (in UTF-8)
    get their SHA-256. ``path`` is the tokenizer's JSON file, which every
    executor has. A piece of n bytes takes time in proportion to n log n.

    Defined cases: null text is empty and has no ids; rows are treated by
    themselves, so repeated rows, ties and empty tables need no care; columns
    of ``df`` with the names added are replaced. ``with_ids`` leaves out ids.
    """
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        added.insert(0, T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in added]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, chunks = load(path), chunks_of(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = [encode(text.as_py(), merges, chunks) for text in part.column(part.num_columns - 1)]
                counts = [len(x) // 4 for x in ids]
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                if with_ids:
                    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))))
                columns += [pa.array(counts, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(decoded(x, merges)).hexdigest() for x in ids])]
                yield pa.RecordBatch.from_arrays(columns, [*(f"c_{i}" for i in range(len(kept))), *names])

    chosen = df.select(*(F.col(c).alias(f"c_{i}") for i, c in enumerate(kept)), F.col(text_col).alias("__text"))
    out = chosen.mapInArrow(run, T.StructType([*chosen.schema.fields[:-1], *added]))
    return out.select(*(F.col(f"c_{i}").alias(c) for i, c in enumerate(kept)), *names)
