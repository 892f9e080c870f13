"""Byte-level BPE: a priority queue of merge ranks over a doubly linked list of symbols.

The vocabulary, the merges and the special tokens are read from a tokenizer file in JSON form; its path is a
parameter and its content is broadcast once (a vocabulary has a fixed size). A text is cut at special tokens,
the rest into pieces by the byte-level pattern, and each piece is merged apart. Equal pieces have equal tokens,
so a worker keeps the tokens of the pieces it met last, in a table of bounded size; the result does not depend
on it. Decoding concatenates the vocabulary's byte strings.

Defined results: a null text is an empty text and has no tokens; a text of any length is encoded whole.
Bytes that are not UTF-8 after decoding become U+FFFD, as the tokenizers library does.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from locusloom.llm.common import small_batches

#: Fixed value: the pattern of byte-level BPE of this kind of tokenizer file.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose tokens a worker keeps, and the longest piece that is kept.
CACHE_PIECES, CACHE_PIECE_CHARS = 400_000, 32


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: printable Latin-1 bytes stand for
    themselves, the others for the characters from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class _Kept(dict):
    """Tokens of the pieces met last; a piece that is missing is merged."""

    def __init__(self, merge):
        self.merge = merge

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.merge(piece.encode("utf-8")))
        if len(piece) <= CACHE_PIECE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class BytePairs:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only byte-level BPE files without a normalizer are supported")
        vocab = model["vocab"]
        symbols = byte_symbols()
        self.first = [vocab.get(s) for s in symbols]
        self.rank_of: list[dict[int, int]] = [{} for _ in range(1 + max(vocab.values()))]  # left, then right
        self.made_by: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank_of[vocab[left]][vocab[right]] = rank
            self.made_by.append(vocab[left + right])
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.strings = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.piece = regex.compile(PIECE)
        self.kept = _Kept(self.merge_piece)

    def merge_piece(self, piece: bytes) -> list[int]:
        """The tokens of one piece: the pair of the least rank is merged first, ties from the left.

        An entry of the queue is rank and place in one number; it is stale if the pair that now begins at
        its place has another rank.
        """
        token = [self.first[b] for b in piece]
        n = len(token)
        rank_of, made_by = self.rank_of, self.made_by
        queue = []
        for i in range(n - 1):
            if (r := rank_of[token[i]].get(token[i + 1], -1)) >= 0:
                queue.append(r * n + i)
        if not queue:
            return token
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            rank, i = divmod(entry, n)
            j = after[i]
            if j < 0 or token[i] < 0 or rank_of[token[i]].get(token[j], -1) != rank:
                continue
            token[i] = made = made_by[rank]
            token[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank_of[made].get(token[k], -1)) >= 0:
                    heappush(queue, r * n + i)
            if (h := before[i]) >= 0 and (r := rank_of[token[h]].get(made, -1)) >= 0:
                heappush(queue, r * n + h)
        return [t for t in token if t >= 0]

    def _plain(self, text: str) -> Iterator[int]:
        return chain.from_iterable(map(self.kept.__getitem__, self.piece.findall(text)))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        start = 0
        if self.cut is not None:
            for found in self.cut.finditer(text):
                out += self._plain(text[start:found.start()])
                out.append(self.special[found.group()])
                start = found.end()
        out += self._plain(text[start:] if start else text)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


_loaded: dict[int, BytePairs] = {}


def _pairs(content) -> BytePairs:
    """The encoder of a broadcast file, made once per worker process."""
    if content.id not in _loaded:
        _loaded.clear()
        _loaded[content.id] = BytePairs(content.value)
    return _loaded[content.id]


class _Shared:
    """A broadcast value with a name that worker processes can look it up by."""

    def __init__(self, spark: SparkSession, content: str):
        self.held = spark.sparkContext.broadcast(content)
        self.id = hash(content)

    @property
    def value(self) -> str:
        return self.held.value


def tokenized(docs: DataFrame, tokenizer: str, outputs: Outputs, text: str = "text") -> DataFrame:
    """Encode and decode every whole text and add what ``outputs`` makes of a batch's ids and decoded texts.

    ``tokenizer`` is the content of the file (``read_tokenizer``). New columns replace old ones of their name.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = _Shared(spark, tokenizer)
    rest = [c for c in docs.columns if c not in outputs.types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(shared)
        for batch in batches:
            ids = [pairs.encode(t or "") for t in batch.column("__text").to_pylist()]
            made = outputs.make(ids, [pairs.decode(r) for r in ids] if outputs.decodes else [])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made], names=[*rest, *outputs.types])

    new = StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in outputs.types.items()))
    schema = StructType([*docs.select(*rest).schema.fields, *new.fields])
    return docs.select(*rest, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Outputs:
    """Columns to add (name and type), and how they come from a batch's token ids and decoded texts."""

    types: dict[str, str]
    make: Callable[[list[list[int]], list[str]], list[pa.Array]]
    decodes: bool = True


def encoded(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the token ids of every text (array of int) and, where asked for, the text decoded from them."""
    def make(rows: list[list[int]], texts: list[str]) -> list[pa.Array]:
        return [pa.array(rows, type=pa.list_(pa.int32()))] + ([pa.array(texts, type=pa.string())] if decoded else [])

    return tokenized(docs, tokenizer, Outputs({ids: "array<int>"} | ({decoded: "string"} if decoded else {}), make, bool(decoded)), text)
