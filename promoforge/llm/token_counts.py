"""Token counts: how many tokens of a public tokenizer each text has, without keeping the tokens.

Texts go to the tokenizer in Arrow tasks, many at a time in batches of about ``BATCH_BYTES`` of UTF-8, so that a batch costs the same
whether it holds a thousand short texts or a part of a long one. Longer texts are cut where the tokenizer begins a new word
in any case, so the counts of the parts add up to the count of the whole. Only numbers leave a task.

A cut lies after a letter or digit and before a blank or punctuation mark that occurs in no special token. Of the word patterns of
byte-level tokenizers no alternative goes on from a letter or digit to such a character, and none looks back; so what is left of the cut
ends a word and what is right of it begins one, with the text around it or without. A stretch without such a place stays whole, however long
it is. Tokenizers with a normaliser, a prefix space, or another way to find words, and sentence-piece models, get their texts whole.

Special strings inside texts count as the library's default has it: one token for ``tokenizers``, ordinary text for ``sentencepiece``.
Nothing is added, truncated or padded.

Defined cases: null and empty texts have 0 bytes and 0 tokens; every row of the input gives one row, repeated rows too; an empty table gives
an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = public_tokenizers.path("byte_bpe_50k.json")
# Bytes of a batch; longer texts are cut into parts of about this size.
BATCH_BYTES = 1 << 18
# Letters and digits in every version of Unicode, and marks that are neither.
LEFT = r"[A-Za-z0-9À-ÖØ-öø-ſΑ-Ρα-ωА-я一-龥]"
RIGHT = " \t\n\r.,;:!?()。，"


class TokenCounter:
    """Counts tokens of texts; built from the bytes of a tokenizer file of ``kind`` json (tokenizers) or model (sentencepiece)."""

    def __init__(self, data: bytes, kind: str, batch_bytes: int = BATCH_BYTES):
        self.batch_bytes = batch_bytes
        self.cut: regex.Pattern | None = None
        if kind == "json":
            # Spark already runs a task per core.
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(data.decode())
            tokenizer.no_padding()
            tokenizer.no_truncation()
            self.count = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self.cut = self._safe_cut(json.loads(data))
        elif kind == "model":
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_proto=data)
            self.count = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        else:
            raise ValueError(f"a tokenizer file is json or model, not {kind}")

    @staticmethod
    def _safe_cut(settings: dict) -> regex.Pattern | None:
        words = settings.get("pre_tokenizer") or {}
        if settings.get("normalizer") or words.get("type") != "ByteLevel" or words.get("add_prefix_space") or not words.get("use_regex", True):
            return None
        special = settings.get("added_tokens", [])
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in special):
            return None
        inside = {c for t in special for c in t["content"]}
        right = "".join(c for c in RIGHT if c not in inside)
        return regex.compile(f"(?<={LEFT})(?=[{regex.escape(right)}])") if right else None

    def parts(self, text: str) -> list[str]:
        """The text in parts of about the batch size, cut at safe places only."""
        # A code point has up to four bytes.
        step = max(1, self.batch_bytes // 4)
        if self.cut is None or len(text) <= step:
            return [text]
        found, start = [], 0
        while len(text) - start > step and (place := self.cut.search(text, start + step)):
            found.append(text[start:place.start()])
            start = place.start()
        return [*found, text[start:]]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        totals = np.zeros(len(texts), np.int64)
        rows: list[int] = []
        waiting: list[str] = []
        size = 0

        def settle():
            np.add.at(totals, rows, self.count(waiting))
            rows.clear()
            waiting.clear()

        for row, text in enumerate(texts):
            for part in self.parts(text) if text else ():
                rows.append(row)
                waiting.append(part)
                size += len(part.encode())
                if size >= self.batch_bytes:
                    settle()
                    size = 0
        if waiting:
            settle()
        return totals


# Counters of this Python worker by digest of their file, kept from task to task.
_COUNTERS: dict[tuple[str, int], TokenCounter] = {}


def _counter(digest: str, shared, kind: str, batch_bytes: int) -> TokenCounter:
    """The counter of a broadcast tokenizer file; at most two are kept."""
    name = digest, batch_bytes
    if name not in _COUNTERS:
        if len(_COUNTERS) > 1:
            _COUNTERS.clear()
        _COUNTERS[name] = TokenCounter(shared.value, kind, batch_bytes)
    return _COUNTERS[name]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per text: id, n_bytes (UTF-8) and n_tokens. ``model`` is a ``.json`` or ``.model`` file the driver can read."""
    data, kind = Path(model).read_bytes(), Path(model).suffix.removeprefix(".")
    if kind not in {"json", "model"}:
        raise ValueError(f"a tokenizer file is .json or .model, not {model}")
    digest, shared = hashlib.sha256(data).hexdigest(), docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(digest, shared, kind, batch_bytes)
        for batch in batches:
            counts = counter.counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(counts)], ["id", "n_bytes", "n_tokens"])

    text = docs[text_col].cast("string")
    given = docs.select(docs[id_col].alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
