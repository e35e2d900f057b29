"""BPE encoding and decoding of whole texts (operator 2).

Encoding is a backtracking search. An Aho-Corasick automaton over the vocabulary gives all token matches of a word; the
longest one at the current place is taken if it is compatible with the token before it, else the next shorter prefix
token, else the last token is taken back. Two tokens are compatible if no merge across their border would have come first;
that is decided by undoing merges and kept in a table. A place that proved to be a dead end is marked, so every place is
left once and the result is what the merges give. Decoding copies bytes out of one array by a table of offsets.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlens.llm.common import slices

#: Stands for the end-of-word suffix inside the automaton; a private character no byte maps to.
WORD_END = "\ue000"
#: Encoded pieces kept per Python worker before the store is emptied (about 100 bytes each; it only saves time).
KEPT = 300_000
_NOT_SPACE_IN_BPE = regex.compile("[\x1c-\x1f]")
_SPACES = regex.compile(r"\s+", regex.V0)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Vocabulary with word ends: lower-cased text in composed form, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        self.suffix = suffix
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(pieces[0])
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.alphabet = dict(enumerate(byte_alphabet()))

        def inner(token: str) -> str:
            return token[: -len(suffix)] + WORD_END if suffix and token.endswith(suffix) and len(token) > len(suffix) else token

        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        made = {a + b for a, b in merges}
        # numbers in merge order: single characters first, then each token by the merge that makes it
        names = [t for t in vocab if t not in made] + [a + b for a, b in merges]
        number = {t: i for i, t in enumerate(names)}
        self.ids = [vocab[t] for t in names]
        self.parts = [(i, i) for i in range(len(names))]
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in merges:
            pair, n = (number[a], number[b]), number[a + b]
            self.merged[pair] = n
            self.parts[n] = pair
        self.fits: dict[tuple[int, int], bool] = {}
        self.length = [len(inner(t)) for t in names]
        self.automaton = ahocorasick.Automaton()
        for n, t in enumerate(names):
            pair = self.parts[n]
            if pair == (n, n) or self._apart(*pair, n):  # else no text ever gives this token
                self.automaton.add_word(inner(t), n)
        self.automaton.make_automaton()
        # decoding: all token strings in one array, each followed by the blank that joins tokens
        size = max([*vocab.values(), *self.special.values()]) + 1
        by_id = [b""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            by_id[i] = t.encode() + b" "
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(b) for b in by_id], out=self.offsets[1:])
        self.store: dict[str, bytes] = {}
        self.word_store: dict[str, bytes] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` apart when they stand side by side."""
        known = self.fits.get((left, right))
        if known is None:
            known = self.fits[left, right] = self._apart(left, right, len(self.parts))
        return known

    def _apart(self, left: int, right: int, before: int) -> bool:
        """No merge with a number below ``before`` crosses the border, nor does an earlier one inside the two tokens."""
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            whole_left, whole_right = self.parts[left][0] == left, self.parts[right][0] == right
            if whole_left and whole_right:
                return True
            # undo the later of the two tokens; on the right an equal merge number still comes after
            if not whole_left and (whole_right or left > right):
                before, left = left, self.parts[left][1]
            else:
                before, right = right + 1, self.parts[right][0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of the split pattern."""
        text = "".join(map(self.alphabet.__getitem__, word.encode())) + (WORD_END if self.suffix else "")
        at: list[list[int]] = [[] for _ in text]
        length = self.length
        for end, n in self.automaton.iter(text):
            at[end + 1 - length[n]].append(n)  # shortest first
        out: list[int] = []
        tried: list[int] = []  # for each token taken, how many matches at its place are left
        dead = bytearray(len(text) + 1)
        place, left = 0, len(at[0])
        while place < len(text):
            here, last = at[place], out[-1] if out else -1
            while left:
                left -= 1
                n = here[left]
                if not dead[place + length[n]] and (last < 0 or self.compatible(last, n)):
                    out.append(n)
                    tried.append(left)
                    place += length[n]
                    left = len(at[place]) if place < len(text) else 0
                    break
            else:
                if not out:
                    raise ValueError(f"no tokens for {word!r}")
                dead[place] = 1
                left = tried.pop()
                place -= length[out.pop()]
        return [self.ids[n] for n in out]

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece without white space, as 32-bit numbers."""
        if piece.isascii():
            text = piece.lower()
            found = [text] if text.isalpha() else self.words.findall(text)
        else:
            # no final sigma here: lower case goes character by character
            found = self.words.findall(unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower())
        out = []
        for word in found:
            ids = self.word_store.get(word)
            if ids is None:
                ids = np.array(self.encode_word(word), np.int32).tobytes()
                if len(word) < 64:
                    self.word_store[word] = ids
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        if "<|" in text:
            parts = self.at_special.split(text)
            return np.frombuffer(b"".join([np.int32(self.special[p]).tobytes() if p in self.special else self._plain(p) for p in parts]), np.int32)
        return np.frombuffer(self._plain(text), np.int32)

    def _plain(self, text: str) -> bytes:
        store = self.store
        pieces = _SPACES.split(text) if _NOT_SPACE_IN_BPE.search(text) else text.split()
        out = list(map(store.get, pieces))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    p = pieces[i]
                    ids = out[i] = self._piece(p)
                    if len(p) < 64:
                        store[p] = ids
            if len(store) > KEPT:
                store.clear()
            if len(self.word_store) > KEPT:
                self.word_store.clear()
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens joined by a blank, special ones included."""
        if not len(ids):
            return b""
        first, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        where = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
        return self.bytes[where][:-1].tobytes()


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def bpe_encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``: the token ids of the whole text (null and empty texts: no ids).

    ``vocabulary`` is the path of a tokenizer file with word ends that every executor has. All other columns and all rows
    stay; a column that is already called ``ids`` is replaced. Texts are independent of each other: no shuffle.
    """
    kept = docs.drop(ids)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for batch in slices(batches, text):
            made = [bpe.encode(t) if t else np.empty(0, np.int32) for t in batch.column(text).to_pylist()]
            offsets = np.zeros(len(made) + 1, np.int32)
            np.cumsum([len(m) for m in made], out=offsets[1:])
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(made), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, ids])

    return kept.mapInArrow(run, schema)


def bpe_decode(docs: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded``: the text of the ids, special tokens included (null or no ids: empty). All rows and columns stay."""
    kept = docs.drop(decoded)
    schema = T.StructType([*kept.schema.fields, T.StructField(decoded, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                column = batch.column(ids)
                offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
                valid = column.is_valid().to_numpy(zero_copy_only=False)
                texts = [bpe.decode(values[a:b]) if ok else b"" for a, b, ok in zip(offsets[:-1], offsets[1:], valid, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*batch.schema.names, decoded])

    return kept.mapInArrow(run, schema)
