"""Spelling variants: words one edit apart, and the frequent word that a rare one is a variant of.

The words of all texts are counted once; those that are long and frequent enough are the vocabulary. Blocked Bloom filters hold it, one for each
word length, and are broadcast. Each task generates the edits of its words (every deletion, and every replacement by a greater letter, so that a
pair is met from one side only: an insertion is the deletion seen from the longer word) and probes them. An edit is never spelled out: its hash
follows from the hash of the word in constant time. Only edits that a filter lets through leave the task, as two hashes, and
meet the vocabulary in an equality join; the words of a pair are then compared, which removes what filters and hashes let through by mistake.
No pair is lost: an edit that is a word passes its filter.

The filters have a fixed greatest size (``MAX_BITS``), whatever the vocabulary; a vocabulary too large for it makes more false positives, which cost
work and no result. Words of ``LONGEST`` letters and more share one filter.

Defined cases: null and empty texts have no words; a null id counts as empty text where words are altered; repeated rows count each time;
words without near words are their own root; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promoforge.llm.common import ascii_lower
from promoforge.session import written_once

# Words are runs of these letters, after A-Z became a-z.
RUNS = "[a-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
# Bits of a filter for each word, and of all filters together (16 MB).
BITS, MAX_BITS = 16, 1 << 27
LONGEST = 64
MAX_ALPHABET = 4096
# Words whose edits are probed together, and words of a task.
CHUNK, TASK = 4096, 100_000
_BASE, _LENGTH = np.uint64(0x9E3779B97F4A7C15), 0xC2B2AE3D27D4EB4F


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sized(sums: np.ndarray, length: int) -> np.ndarray:
    """Keys of words of a length from the sums of their letters."""
    return _mixed(sums + np.uint64(length * _LENGTH % (1 << 64)))


def _powers(length: int) -> np.ndarray:
    out = np.ones(length + 1, np.uint64)
    out[1:] = _BASE
    return np.multiply.accumulate(out)


def _letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def word_keys(letters: np.ndarray) -> np.ndarray:
    """64-bit keys of words of one length."""
    length = letters.shape[1]
    return _sized((letters * _powers(length)[:length]).sum(axis=1, dtype=np.uint64), length)


def _by_length(words: list[str]) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        found.setdefault(len(w), []).append(i)
    return found


def _masks(keys: np.ndarray) -> np.ndarray:
    """Five bits of a block for each key."""
    out = np.zeros(len(keys), np.uint64)
    for k in range(5):
        out |= np.uint64(1) << (keys >> np.uint64(6 * k) & np.uint64(63))
    return out


@dataclass(frozen=True)
class Filters:
    """One blocked filter per word length, in one array; ``places`` has the first block and the number of blocks of each."""

    blocks: np.ndarray
    places: dict[int, tuple[int, int]]

    @staticmethod
    def layout(counts: dict[int, int], bits: int = BITS, most: int = MAX_BITS) -> dict[int, tuple[int, int]]:
        share = min(1.0, (most // 64 - len(counts)) / max(1, ceil(sum(counts.values()) * bits / 64)))
        places, start = {}, 0
        for shard, n in sorted(counts.items()):
            size = max(1, int(ceil(n * bits / 64) * share))
            places[shard] = start, size
            start += size
        return places

    @staticmethod
    def block_of(keys: np.ndarray, place: tuple[int, int]) -> np.ndarray:
        return (np.uint64(place[0]) + ((keys >> np.uint64(32)) * np.uint64(place[1]) >> np.uint64(32))).astype(np.int64)

    def maybe(self, keys: np.ndarray, length: int) -> np.ndarray:
        """Which keys may be words of this length."""
        place = self.places.get(min(length, LONGEST))
        if place is None:
            return np.zeros(len(keys), bool)
        bits = _masks(keys)
        return self.blocks[self.block_of(keys, place)] & bits == bits


def probe(words: list[str], filters: Filters, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of words of one length, and of those of their edits that may be words: each deletion, and each replacement by a greater letter."""
    letters = _letters(words)
    size, length = letters.shape
    powers = _powers(length)
    terms = letters * powers[:length]
    total = terms.sum(axis=1, dtype=np.uint64)
    keys = _sized(total, length)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []

    def take(rows: np.ndarray, edits: np.ndarray, of: int):
        edits = _sized(edits, of)
        hit = filters.maybe(edits, of)
        left.append(keys[rows[hit]])
        right.append(edits[hit])

    everyone = np.arange(size)
    before = np.zeros(size, np.uint64)
    lower = letters[:, 1:] * powers[:length - 1]
    after = lower.sum(axis=1, dtype=np.uint64)
    for i in range(length):
        # Equal neighbours give the same deletion.
        rows = everyone if i == 0 else np.flatnonzero(letters[:, i] != letters[:, i - 1])
        take(rows, before[rows] + after[rows], length - 1)
        before = before + terms[:, i]
        if i < length - 1:
            after = after - lower[:, i]
        rows, which = np.nonzero(alphabet > letters[:, i, None])
        take(rows, total[rows] + (alphabet[which] - letters[rows, i]) * powers[i], length)
    return np.concatenate(left), np.concatenate(right)


def probe_wide(word: str, filters: Filters, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`probe` for one long word: all its places at once instead of all words at one place."""
    letters = _letters([word])[0]
    length = len(letters)
    powers = _powers(length)[:length]
    terms = letters * powers
    total = terms.sum(dtype=np.uint64)
    found: list[np.ndarray] = []

    def take(edits: np.ndarray, of: int):
        edits = _sized(edits, of)
        found.append(edits[filters.maybe(edits, of)])

    before = np.cumsum(terms, dtype=np.uint64) - terms
    lower = np.append(letters[1:] * powers[:-1], np.uint64(0))
    after = np.cumsum(lower[::-1], dtype=np.uint64)[::-1]
    new = np.append(True, letters[1:] != letters[:-1])
    take((before + after)[new], length - 1)
    for start in range(0, length, CHUNK):
        here = letters[start:start + CHUNK, None]
        places, which = np.nonzero(alphabet > here)
        take(total + (alphabet[which] - here[places, 0]) * powers[start + places], length)
    right = np.concatenate(found)
    return np.full(len(right), _sized(np.array([total]), length)[0]), right


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        keys = np.zeros(len(words), np.uint64)
        for rows in _by_length(words).values():
            keys[rows] = word_keys(_letters([words[i] for i in rows]))
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), _signed(keys), pa.array([min(len(w), LONGEST) for w in words], pa.int32())],
                                         ["word", "n", "key", "shard"])


def _filled(places: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, shards = batch.column("key").to_numpy().view(np.uint64), batch.column("shard").to_numpy()
            blocks = np.zeros(len(keys), np.int64)
            for shard in np.unique(shards).tolist():
                rows = shards == shard
                blocks[rows] = Filters.block_of(keys[rows], places[shard])
            yield pa.RecordBatch.from_arrays([pa.array(blocks), _signed(_masks(keys))], ["block", "bits"])

    return run


def _probed(shared, alphabet: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[str] = []

        def settle():
            for length, rows in _by_length(waiting).items():
                found = (probe([waiting[i] for i in rows], shared.value, alphabet),) if length <= LONGEST else (probe_wide(waiting[i], shared.value, alphabet) for i in rows)
                for a, b in found:
                    yield pa.RecordBatch.from_arrays([_signed(a), _signed(b)], ["a_key", "b_key"])
            waiting.clear()

        for batch in batches:
            waiting += batch.column("word").to_pylist()
            if len(waiting) >= CHUNK:
                yield from settle()
        yield from settle()

    return run


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alter: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``word`` and ``n``, its occurrences in all texts; ``alter`` (of id and run) may change each run first."""
    runs = F.explode(F.regexp_extract_all(ascii_lower(F.coalesce(docs[text_col].cast("string"), F.lit(""))), F.lit(RUNS), F.lit(0)))
    each = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), runs.alias("run"))
    word = F.col("run") if alter is None else alter(F.col("id"), F.col("run"))
    return each.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def near_words(vocabulary: DataFrame, bits: int = BITS, most: int = MAX_BITS) -> DataFrame:
    """Pairs (word, near, near_n) of words exactly one edit apart, both ways; ``vocabulary`` (word, n, key, shard) is stored."""
    spark = vocabulary.sparkSession
    counts = {r.shard: r.n for r in vocabulary.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().limit(MAX_ALPHABET + 1).collect()
    if len(letters) > MAX_ALPHABET:
        raise ValueError(f"words of more than {MAX_ALPHABET} different letters")
    places = Filters.layout(counts, bits, most)
    blocks = np.zeros(sum(size for _, size in places.values()), np.uint64)
    # At most one row for each block of filters of bounded size.
    filled = vocabulary.select("key", "shard").mapInArrow(_filled(places), "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    blocks[filled.column("block").to_numpy()] = filled.column("bits").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(Filters(blocks, places))
    alphabet = np.sort(np.array([ord(r.c) for r in letters], np.uint64))
    tasks = max(spark.sparkContext.defaultParallelism, ceil(sum(counts.values()) / TASK))
    found = vocabulary.select("word").repartition(tasks).mapInArrow(_probed(shared, alphabet), "a_key long, b_key long")
    a, b = (vocabulary.select(F.col("key").alias(f"{s}_key"), F.col("word").alias(s), F.col("n").alias(f"{s}_n")) for s in "ab")
    pairs = found.join(b, "b_key").join(a, "a_key").where(F.levenshtein("a", "b", 1) == 1)
    both = F.explode(F.array(*(F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in ("ab", "ba"))))
    return pairs.select(both.alias("p")).select("p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """Last word of each chain of (word, form); counts grow along a chain, so there are no circles. A chain is halved in every round."""
    now = written_once(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        hop = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written_once(now.join(hop, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variants-roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def group_variants(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, bits: int = BITS, most: int = MAX_BITS) -> DataFrame:
    """One row per word of ``words`` (word, n) that is long and frequent enough: word, n, n_near, form, form_n and root.

    The form is the most frequent near word (the smallest in code-point order of equals) if it is ``ratio`` times as frequent at least.
    """
    chosen = words.where((F.char_length("word") >= min_length) & (F.col("n") >= min_count)).select("word", "n")
    vocabulary = written_once(chosen.mapInArrow(_keyed, "word string, n long, key long, shard int"), "variants-words")
    near = near_words(vocabulary, bits, most).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    far = -F.col("best.less") >= ratio * F.col("n")
    named = vocabulary.select("word", "n").join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best.form")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n"))
    named = written_once(named, "variants-forms")
    roots = _roots(named.where("form IS NOT NULL").select("word", "form"))
    return named.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
