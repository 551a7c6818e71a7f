"""Line deduplication by pairwise alignment.

Each repeated line that is long enough to be deleted names its first holder, the earliest text with that line, and so does each repeated run of
lines. A text is aligned with the first holders of its lines and runs, so the pairs grow with the lines and not with the square of a group; the lines that are
rarest in both texts are the anchors of a patience diff, and the blocks of lines aligned that way are deleted from
the later text if they are long enough. Whole copies of a text are found by their digest and need no alignment.
Decisions are made on the texts as given: what is deleted elsewhere does not matter.

Lines are compared with blanks around and between words made one space; lines without a word separate nothing and
are never deleted by themselves, only inside an aligned block. Words are runs of non-blank characters.

A line of too few words makes no block by itself, so only longer lines name their first holder alone; common short lines make no pairs.
First holders of single lines are not enough either: each line of a block may occur earlier by itself. So every shortest run of
lines that reaches the least number of words, from each line on and back from each line, names its first holder too. Every line of
a block that an earlier text has lies in such a run inside the block, so the text is aligned with the earliest
text that holds this run. Only runs of lines that all occur in other texts are formed. An alignment is in one order: blocks that
two texts have in crossing order are not all found by it.

Defined cases: null texts have no lines and stay null; empty texts stay as they are; equal texts are one text, of
which the smallest id (null ids last, then the digest) is the first and keeps its lines; empty tables give empty
results. Only the named columns are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promoforge.llm.common import BLANKS, fresh, let, text_key
from promoforge.session import written_once

# A block of aligned lines is deleted from this many words on.
MIN_WORDS = 20


def line_hashes(text: Column) -> Column:
    """Hash and number of words of every line; hash 0 for lines without a word."""
    def hashed(clean):
        words = F.when(clean == "", 0).otherwise(F.char_length(clean) - F.char_length(F.replace(clean, F.lit(" "), F.lit(""))) + 1)
        return F.struct(F.when(clean == "", F.lit(0).cast("long")).otherwise(F.xxhash64(clean)).alias("h"), words.cast("int").alias("n"))

    def one(line):
        return let(F.btrim(F.regexp_replace(line, "[ \\t-\\r]+", " "), F.lit(BLANKS)), hashed)

    return F.when(text.isNull(), F.array().cast("array<struct<h:bigint,n:int>>")).otherwise(F.transform(F.split(text, "\n", -1), one))


def _patience(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int, out: list[tuple[int, int]]) -> None:
    """Aligned positions of a[a0:a1] and b[b0:b1], appended in order: equal ends, then the longest
    increasing run of the lines that are unique on both sides, and so on between them."""
    todo = [(a0, a1, b0, b1)]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        common = in_a.keys() & in_b.keys()
        if not common:
            continue
        # The rarest common lines anchor; copies pair up in order, so that a line repeated alike on both sides counts.
        rare = min(max(in_a[x], in_b[x]) for x in common)
        pick = {x for x in common if max(in_a[x], in_b[x]) == rare}
        seen: Counter = Counter()
        where: dict[tuple[int, int], int] = {}
        for i in range(a0, a1):
            if a[i] in pick:
                where[a[i], seen[a[i]]] = i
                seen[a[i]] += 1
        seen.clear()
        pairs = []
        for j in range(b0, b1):
            if b[j] in pick:
                i = where.get((b[j], seen[b[j]]))
                seen[b[j]] += 1
                if i is not None:
                    pairs.append((i, j))
        tails: list[int] = []
        at: list[int] = []
        back: list[int] = []
        for k, (i, _) in enumerate(pairs):
            pos = bisect_left(tails, i)
            back.append(at[pos - 1] if pos else -1)
            if pos == len(tails):
                tails.append(i)
                at.append(k)
            else:
                tails[pos], at[pos] = i, k
        chain, k = [], at[-1]
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        chain.reverse()
        last_i, last_j = a0, b0
        for i, j in chain:
            out.append((i, j))
            todo.append((last_i, i, last_j, j))
            last_i, last_j = i + 1, j + 1
        todo.append((last_i, a1, last_j, b1))


def common_blocks(earlier: list[int], later: list[int], words: list[int], min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Runs (start, end) of ``later`` to delete: consecutive aligned lines, blank ones aside, with enough words."""
    a = [h for h in earlier if h]
    place = [i for i, h in enumerate(later) if h]
    b = [later[i] for i in place]
    matched: list[tuple[int, int]] = []
    _patience(a, b, 0, len(a), 0, len(b), matched)
    matched.sort(key=lambda x: x[1])
    runs, k = [], 0
    while k < len(matched):
        e = k + 1
        while e < len(matched) and matched[e] == (matched[e - 1][0] + 1, matched[e - 1][1] + 1):
            e += 1
        first, last = matched[k][1], matched[e - 1][1]
        if sum(words[place[i]] for i in range(first, last + 1)) >= min_words:
            runs.append((place[first], place[last] + 1))
        k = e
    return runs


def _align(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, ends = [], [], []
            # A pair at a time: as Python numbers the lines take many times their room in the batch.
            for row in range(batch.num_rows):
                key, later, words, earlier = (batch.column(c)[row].as_py() for c in ("key", "h", "n", "eh"))
                for a, b in common_blocks(earlier, later, words, min_words):
                    keys.append(key)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["key", "start", "end"])

    return run


def shortest_runs(lines: list[int], words: list[int], known: set[int], min_words: int = MIN_WORDS) -> set[int]:
    """Hashes of the shortest runs of two and more lines, all of them ``known`` or blank, that have enough words: from each line on and back from each line."""
    found: set[tuple[int, int]] = set()
    place = [i for i, h in enumerate(lines) if h]
    hashes = np.array([lines[i] for i in place], np.int64)
    total = [0]
    for i in place:
        total.append(total[-1] + words[i])
    k = 0
    while k < len(place):
        stop = k
        while stop < len(place) and lines[place[stop]] in known:
            stop += 1
        end = start = k
        for i in range(k, stop):
            # The least end for this start, and the greatest start for this end.
            while end < stop and (end <= i or total[end] - total[i] < min_words):
                end += 1
            if end > i + 1 and total[end] - total[i] >= min_words:
                found.add((i, end))
            while start < i and total[i + 1] - total[start + 1] >= min_words:
                start += 1
            if start < i and total[i + 1] - total[start] >= min_words:
                found.add((start, i + 1))
        k = stop + 1
    return {xxhash.xxh64_intdigest(hashes[i:e].tobytes()) for i, e in found}


def _runs(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = []
            for row in range(batch.num_rows):
                h, n, known = (batch.column(c)[row].as_py() for c in ("h", "n", "known"))
                runs.append(np.array([*shortest_runs(h, n, set(known), min_words)], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("place"), pa.array(runs, pa.list_(pa.int64()))], ["key", "place", "runs"])

    return run


def _first_holders(held: DataFrame, what: str) -> DataFrame:
    """``what`` and the first of the texts that hold it, where more than one does."""
    holders = held.groupBy(what).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("texts"))
    return written_once(holders.where("texts > 1").select(what, "first"), f"{what}-holders")


def _place(id_col: Column, key: Column) -> Column:
    """Order of the texts: by id, null ids last, then by digest."""
    return F.struct(id_col.isNull().alias("last"), id_col.alias("id"), key.alias("key"))


def line_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per distinct text: key, ``first`` (the place that keeps its lines), n_words and ``cut`` (runs of lines to delete)."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", text_key(F.col("text")))
    read = given.select("key", _place(F.col("id"), F.col("key")).alias("place"), line_hashes(F.col("text")).alias("lines"))
    texts = read.groupBy("key").agg(F.min("place").alias("place"), F.first("lines").alias("lines"))
    texts = written_once(texts.select("key", "place", F.col("lines.h").alias("h"), F.col("lines.n").alias("n")), "line-texts")
    # Pairs: each long line of a text names the first text that holds it, and so does each run.
    lines = F.array_distinct(F.transform(F.arrays_zip("h", "n"), lambda x: F.struct(x["h"].alias("line"), x["n"].alias("words"))))
    held = texts.select("key", "place", F.inline(lines)).where("line <> 0")
    mine = written_once(held.join(_first_holders(held, "line"), "line"), "line-held")
    known = mine.groupBy("key").agg(F.collect_list("line").alias("known")).where(F.size("known") > 1)
    formed = texts.join(known, "key").select("key", "place", "h", "n", "known")
    place = texts.schema["place"].dataType.simpleString()
    formed = formed.mapInArrow(_runs(min_words), f"key binary, place {place}, runs array<bigint>")
    runs = written_once(formed.select("key", "place", F.explode("runs").alias("run")), "line-runs")
    # A line by itself makes a block only if it has enough words; shorter ones count in the runs they lie in.
    alone = mine.where(F.col("words") >= min_words)
    named = alone.select("key", "place", "first").unionByName(runs.join(_first_holders(runs, "run"), "run").select("key", "place", "first"))
    pairs = named.where(F.col("place") != F.col("first")).select("key", F.col("first.key").alias("other")).distinct()
    pairs = written_once(pairs, "line-pairs")
    # Alignment needs the line hashes of both; a first holder of many texts is a hot key that Spark splits.
    earlier = texts.select(F.col("key").alias("other"), F.col("h").alias("eh"))
    both = pairs.join(earlier, "other").select("key", "eh").join(texts.select("key", "h", "n"), "key").select("key", "h", "n", "eh")
    blocks = both.mapInArrow(_align(min_words), "key binary, start int, end int")
    cut = blocks.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("cut"))
    words = F.aggregate("n", F.lit(0), lambda a, x: a + x)
    return written_once(texts.select("key", F.col("place").alias("first"), words.alias("n_words")).join(cut, "key", "left"), "line-decisions")


def _decided(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> tuple[DataFrame, str, str, str]:
    """``docs`` with three more columns: key, whether a later whole copy, the lines that stay."""
    decisions = line_decisions(docs, id_col, text_col, min_words)
    key, first, total, cut, copy, kept = (fresh(n) for n in ("key", "first", "total", "cut", "copy", "kept"))
    decisions = decisions.select(F.col("key").alias(key), F.col("first").alias(first), F.col("n_words").alias(total), F.col("cut").alias(cut))
    text = docs[text_col].cast("string")
    found = docs.join(decisions, text_key(text) == decisions[key])
    lines = F.split(text, "\n", -1)
    stay = F.filter(lines, lambda line, i: ~F.exists(cut, lambda c: (i >= c["start"]) & (i < c["end"])))
    found = found.withColumn(copy, (_place(docs[id_col], F.col(key)) != F.col(first)) & (F.col(total) >= min_words))
    found = found.withColumn(kept, F.when(F.col(copy), F.array().cast("array<string>")).when(F.col(cut).isNull(), lines).otherwise(stay))
    return found, key, copy, kept


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per text: id, ``key`` (see ``text_key``), text (what stays), n_lines, n_removed, ``copy`` (a later whole copy)."""
    found, key, copy, kept = _decided(docs, id_col, text_col, min_words)
    lines = F.coalesce(F.size(F.split(docs[text_col].cast("string"), "\n", -1)), F.lit(0)).cast("long")
    lines = F.when(docs[text_col].isNull(), F.lit(0).cast("long")).otherwise(lines)
    left = F.when(docs[text_col].isNull(), F.lit(0)).otherwise(F.size(kept)).cast("long")
    return found.select(docs[id_col].alias("id"), F.col(key).alias("key"), F.array_join(kept, "\n").alias("text"), lines.alias("n_lines"),
                        (lines - left).alias("n_removed"), F.col(copy).alias("copy"))


def delete_common(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the common blocks deleted from the later texts and the sizes set anew, if there is such a column.

    A text that loses all its words goes; a text without words before stays as it is.
    """
    found, _, copy, kept = _decided(docs, id_col, text_col, min_words)
    said = F.array_join(kept, "\n")
    whole = docs[text_col].cast("string")
    emptied = F.coalesce(whole.rlike("[^ \\t-\\r]"), F.lit(False)) & ~F.coalesce(said.rlike("[^ \\t-\\r]"), F.lit(False))
    columns = [said.alias(c) if c == text_col else F.when(whole.isNull(), docs[c]).otherwise(F.char_length(said)).cast(docs.schema[c].dataType).alias(c)
               if c == size_col else docs[c] for c in docs.columns]
    return found.where(~emptied).select(*columns)
