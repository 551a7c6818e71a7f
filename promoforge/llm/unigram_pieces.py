"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A text gets the whitespace marker in front and for every space; the best segmentation is the one with the
largest sum of piece scores. Texts are cut where no piece of the vocabulary can cross (before markers, and between letters and
most signs), and every part is solved by itself, with the same result as for the whole text; parts are remembered by
the worker, up to a bound. A character no piece covers is written as its UTF-8 bytes. Decoding joins the pieces,
turns markers into spaces, drops the one in front, and reads byte pieces as bytes.

The vocabulary and its trie are broadcast: their size is that of the model file, checked against ``MAX_PIECES``.
Files of merge rules hold ranks instead of log scores; a rank r then counts as the log score -ln(1 + r).

Defined cases: null and empty texts have no pieces and decode to the empty text; a marker character in a text decodes to a
space, everything else decodes to itself; rows are encoded one by one, so repeats and ties do not matter (of equal
scores the segmentation found first from the left stays); empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from promoforge.llm.common import slices

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_PIECES = 1 << 20
# How far below the worst piece an uncovered character scores.
UNKNOWN_PENALTY = 10.0
# Parts remembered by a task, and the longest of them in characters.
REMEMBERED, LONGEST = 400_000, 48
_NEVER = -math.inf


def _cutter(pieces: list[str]) -> re.Pattern:
    """Finds the parts of a marked text. A cut lies before a run of markers, and between a letter or digit and a sign that
    no piece holds in this order side by side: no piece can cross it, so cutting there changes no segmentation."""
    signs = [c for c in map(chr, range(128)) if not c.isalnum() and c != " "]
    after = {b for p in pieces for a, b in zip(p, p[1:]) if a.isalnum()}
    before = {a for p in pieces for a, b in zip(p, p[1:]) if b.isalnum()}
    closing = "".join(re.escape(c) for c in signs if c not in after)
    opening = "".join(re.escape(c) for c in signs if c not in before)
    word = r"[^\W_]"
    cut = ([f"{MARK}*{word}+(?=[{closing}])"] if closing else []) + ([f"[{opening}]+(?={word})"] if opening else [])
    return re.compile("|".join([*cut, f"{MARK}*[^{MARK}]+", f"{MARK}+"]))


class DoubleArray:
    """Trie of byte strings in two arrays: the child of state s by byte c is base[s] + c + 1 if check of it is s."""

    def __init__(self, entries: dict[bytes, int]):
        keys = sorted(entries)
        self.base, self.check, self.value = [0], [-1], [-1]
        # No base below 257: a child never lands on the root.
        self._free = self._next = 514
        todo = [(0, 0, len(keys), 0)]
        while todo:
            state, low, high, depth = todo.pop()
            if low < high and len(keys[low]) == depth:
                self.value[state] = entries[keys[low]]
                low += 1
            groups = []
            while low < high:
                byte, start = keys[low][depth], low
                while low < high and keys[low][depth] == byte:
                    low += 1
                groups.append((byte, start, low))
            if groups:
                base = self._place([g[0] for g in groups])
                self.base[state] = base
                for byte, start, end in groups:
                    self.check[base + byte + 1] = state
                for byte, start, end in groups:
                    todo.append((base + byte + 1, start, end, depth + 1))

    def _place(self, labels: list[int]) -> int:
        """A base at which all labels fall on free cells: the first free cell for one label, else the next fit."""
        if len(labels) == 1:
            while self._free < len(self.check) and self.check[self._free] != -1:
                self._free += 1
            base = self._free - labels[0] - 1
        else:
            base = self._next
        while True:
            top = base + labels[-1] + 2
            if top > len(self.check):
                more = top - len(self.check) + 4096
                self.base += [0] * more
                self.check += [-1] * more
                self.value += [-1] * more
            if all(self.check[base + c + 1] == -1 for c in labels):
                if len(labels) > 1:
                    self._next = base
                return base
            base += 1


class Vocabulary:
    """Pieces with log scores; ``kind`` says how the file's scores are read: "log" as they are, "rank" as ranks."""

    def __init__(self, pieces: list[str], scores: list[float], types: list[str]):
        if len(pieces) > MAX_PIECES:
            raise ValueError(f"{len(pieces)} pieces; the bound for broadcasting is {MAX_PIECES}")
        self.byte_ids = {}
        self.surface: list[bytes] = []
        entries, normal = {}, []
        for i, (piece, kind) in enumerate(zip(pieces, types, strict=True)):
            self.surface.append(b"")
            if kind == "byte":
                self.byte_ids[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif kind == "normal":
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"a marker inside piece {i}: texts could not be cut at markers")
                entries[piece.encode()] = i
                normal.append(scores[i])
                self.surface[i] = piece.replace(MARK, " ").encode()
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        self.scores = scores
        self.unknown = min(normal) - UNKNOWN_PENALTY
        self.trie = DoubleArray(entries)
        # Scores by state; the padding keeps every step inside the arrays.
        self.trie.check += [-2] * 257
        self.gain = [scores[v] if v >= 0 else None for v in self.trie.value] + [None] * 257
        self.ascii_pieces = [bytes([b]) in entries for b in range(128)]
        self.wide_pieces = {e for e in entries if len(e) > 1 and len(e.decode()) == 1}
        self.parts = _cutter([p for p, kind in zip(pieces, types, strict=True) if kind == "normal"])
        self.name = hashlib.sha256(repr((pieces, scores)).encode()).hexdigest()

    @classmethod
    def load(cls, path: str, kind: str = "rank") -> Vocabulary:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        types = ["byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal" for i in ids]
        scores = [model.get_score(i) for i in ids]
        return cls([model.id_to_piece(i) for i in ids], [-math.log1p(-s) for s in scores] if kind == "rank" else scores, types)

    def solve(self, part: str) -> list[int]:
        """Best pieces of one part."""
        data = part.encode()
        base, check, value, gain, ascii_pieces, n = self.trie.base, self.trie.check, self.trie.value, self.gain, self.ascii_pieces, len(data)
        unknown = self.unknown
        best, back, piece = [_NEVER] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            here = best[at]
            if here == _NEVER:
                continue  # inside a character
            state, first = 0, data[at]
            for j in range(at, n):
                nxt = base[state] + data[j] + 1
                if check[nxt] != state:
                    break
                state = nxt
                more = gain[nxt]
                if more is not None:
                    more += here
                    if more > best[j + 1]:
                        best[j + 1], back[j + 1], piece[j + 1] = more, at, value[nxt]
            if first < 128:
                if ascii_pieces[first]:
                    continue
                end = at + 1
            else:
                end = at + (2 if first < 224 else 3 if first < 240 else 4)
                if data[at:end] in self.wide_pieces:
                    continue
            if here + unknown > best[end]:
                best[end], back[end], piece[end] = here + unknown, at, -1
        out: list[int] = []
        while n:
            start = back[n]
            if piece[n] >= 0:
                out.append(piece[n])
            else:
                out += [self.byte_ids[b] for b in reversed(data[start:n])]
            n = start
        out.reverse()
        return out


class Encoder(dict):
    """Pieces of a part, as bytes of int32; remembers what it was asked."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, part: str) -> bytes:
        ids = np.array(self.vocabulary.solve(part), np.int32).tobytes()
        if len(part) <= LONGEST and len(self) < REMEMBERED:
            self[part] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        parts = self.vocabulary.parts.findall(MARK + text.replace(" ", MARK))
        return np.frombuffer(b"".join(map(self.__getitem__, parts)), np.int32)

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.vocabulary.surface.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _vocabulary(path: str, kind: str) -> Vocabulary:
    return Vocabulary.load(path, kind)


# Encoders of this Python worker by vocabulary: what one task has solved, the next task of the worker knows.
_ENCODERS: dict[str, Encoder] = {}


def _encoder(name: str, shared) -> Encoder:
    """The encoder of the vocabulary called ``name``; at most two are kept."""
    if name not in _ENCODERS:
        if len(_ENCODERS) > 1:
            _ENCODERS.clear()
        _ENCODERS[name] = Encoder(shared.value)
    return _ENCODERS[name]


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, kind: str = "rank") -> DataFrame:
    """One row per text: id, ``ids`` (pieces), n_tokens, n_byte_tokens, and ``exact``: the pieces decode to the text, markers in it read as spaces."""
    spark: SparkSession = docs.sparkSession
    vocabulary = _vocabulary(model, kind)
    name, shared = vocabulary.name, spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, shared)
        is_byte = np.zeros(len(encoder.vocabulary.surface), bool)
        is_byte[list(encoder.vocabulary.byte_ids.values())] = True
        for batch in slices(batches):
            lengths, ids, exact, fallback = [0], [], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                found = encoder.encode(text)
                ids.append(found)
                lengths.append(lengths[-1] + len(found))
                fallback.append(int(is_byte[found].sum()))
                exact.append(encoder.decode(found.tolist()) == text.replace(MARK, " "))
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, pa.array(np.diff(lengths)), pa.array(fallback, pa.int64()), pa.array(exact, pa.bool_())],
                                             ["id", "ids", "n_tokens", "n_byte_tokens", "exact"])

    text = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    id_type = text.schema["id"].dataType.simpleString()
    return text.mapInArrow(run, f"id {id_type}, ids array<int>, n_tokens long, n_byte_tokens long, exact boolean")


def decode_pieces(rows: DataFrame, id_col: str = "id", ids_col: str = "ids", model: str = MODEL, kind: str = "rank") -> DataFrame:
    """One row per list of pieces: id and text; null lists decode to the empty text."""
    vocabulary = _vocabulary(model, kind)
    name, shared = vocabulary.name, rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, shared)
        for batch in batches:
            texts = [encoder.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    picked = rows.select(rows[id_col].alias("id"), rows[ids_col].alias("ids"))
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, text string")
