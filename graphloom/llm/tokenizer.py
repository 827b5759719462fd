"""Byte-level BPE encoding of a whole corpus with a public tokenizer.

The encoder takes the longest vocabulary entry at each position (found by one Aho-Corasick
pass), accepts it if the pair with the token before is one that merging would leave apart,
and otherwise steps back to the next shorter entry.  The pair test is remembered in a
compatibility table, so the exact merge result costs linear time.  Decoding reads an offset
table over the concatenated token bytes.

Defined results: a null text and an empty text both give an empty list; special-token strings
inside a text are ordinary text; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER_DIR = "/opt/tokenizers"
#: The published split pattern of this vocabulary.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker's memory of encoded pieces is emptied when it holds so many.
CACHE_PIECES = 400_000

_LOADED: dict[str, "BytePairEncoder"] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file, built from its rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {chr(b): b for b in shown}, 256
    for b in range(256):
        if b not in shown:
            table[chr(spare)] = b
            spare += 1
    return table


class _Pieces(dict):
    """piece -> ids, filled on demand."""

    def __init__(self, encoder: "BytePairEncoder") -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHE_PIECES:
            self.clear()
        ids = tuple(self.encoder.encode_bytes(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class BytePairEncoder:
    """Exact byte-pair encoding by backtracking over longest matches."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        alphabet = byte_alphabet()
        raw = lambda shown: bytes(alphabet[c] for c in shown)
        self.id_of = {raw(shown): number for shown, number in model["vocab"].items() if all(c in alphabet for c in shown)}
        parts = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.made_from: dict[int, tuple[int, int]] = {}
        for order, (left, right) in enumerate(parts):
            pair = (model["vocab"][left], model["vocab"][right])
            self.rank[pair] = order
            self.made_from[model["vocab"][left + right]] = pair
        self.order = {number: self.rank[pair] for number, pair in self.made_from.items()}
        in_merges = set(self.made_from) | {self.id_of[bytes([b])] for b in range(256)}
        self.bytes_of = {number: text for text, number in self.id_of.items() if number in in_merges}
        self.length = {number: len(text) for number, text in self.bytes_of.items()}
        self.matcher = ahocorasick.Automaton()
        for number, text in self.bytes_of.items():
            self.matcher.add_word(text.decode("latin-1"), (len(text), number))
        self.matcher.make_automaton()
        self.shorter: dict[int, int] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.find = regex.compile(SPLIT_PATTERN).findall
        self.pieces = _Pieces(self)

    def _prefix(self, token: int) -> int:
        """The longest vocabulary entry that is a proper prefix of token, or -1."""
        found = self.shorter.get(token)
        if found is None:
            text, found = self.bytes_of[token], -1
            for size in range(len(text) - 1, 0, -1):
                number = self.id_of.get(text[:size])
                if number in self.length:
                    found = number
                    break
            self.shorter[token] = found
        return found

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both ends with exactly these two tokens.

        The merges next to the border are undone from the latest on. Two ends that ever lay
        side by side would have merged if their own merge comes before the one that took
        either of them; of equal merges the left one comes first.
        """
        known = self.apart.get((left, right))
        if known is not None:
            return known
        a, b, result = left, right, True
        left_taken = right_taken = len(self.rank)
        while True:
            together = self.rank.get((a, b))
            if together is not None and together < left_taken and together <= right_taken:
                result = False
                break
            made_a, made_b = self.order.get(a, -1), self.order.get(b, -1)
            if made_a > made_b:
                left_taken, a = made_a, self.made_from[a][1]
            elif made_b >= 0:
                right_taken, b = made_b, self.made_from[b][0]
            else:
                break
        self.apart[left, right] = result
        return result

    def encode_bytes(self, text: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.id_of.get(text)
        if whole in self.length:
            return [whole]
        size = len(text)
        longest, reach = [0] * size, [0] * size
        for end, (length, number) in self.matcher.iter(text.decode("latin-1")):
            start = end - length + 1
            if length > reach[start]:
                reach[start], longest[start] = length, number
        dead = bytearray(size + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            end = at + self.length[token]
            if not dead[end] and (not ids or self._compatible(ids[-1], token)):
                ids.append(token)
                at = end
                if at < size:
                    token = longest[at]
                continue
            token = self._prefix(token)
            if token < 0:
                dead[at] = 1
                token = ids.pop()
                at -= self.length[token]
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text, without special tokens."""
        if not text:
            return np.empty(0, np.int32)
        return np.fromiter(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))), np.int32)

    def decoding_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """All token bytes in one buffer, and where each token starts in it."""
        size = max(self.bytes_of) + 1
        lengths = np.zeros(size + 1, np.int64)
        for number, length in self.length.items():
            lengths[number + 1] = length
        return np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8), np.cumsum(lengths)

    def decode(self, ids: np.ndarray) -> bytes:
        """Inverse of encode, by the offset table."""
        buffer, starts = self.decoding_tables()
        ids = np.asarray(ids, np.int64)
        lengths = starts[ids + 1] - starts[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        within = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
        return buffer[np.repeat(starts[ids], lengths) + within].tobytes()


def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> BytePairEncoder:
    """The encoder of this process for a vocabulary file of the tokenizer folder."""
    path = os.path.join(folder, f"{name}.json")
    if path not in _LOADED:
        _LOADED[path] = BytePairEncoder(path)
    return _LOADED[path]


def encode_corpus(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR
) -> DataFrame:
    """(id, ids array<int>) for every row of documents; no shuffle, one Arrow pass."""
    import pyarrow as pa

    id_type = documents.schema[id_col].dataType

    def run(batches: Iterator["pa.RecordBatch"]) -> Iterator["pa.RecordBatch"]:
        model = encoder(name, folder)
        for batch in batches:
            rows = [model.encode(text) for text in batch.column(1).to_pylist()]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            values = np.concatenate(rows) if rows else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))], ["id", "ids"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    pairs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return pairs.mapInArrow(run, schema).withColumnRenamed("id", id_col)
