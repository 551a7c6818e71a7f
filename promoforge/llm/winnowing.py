"""Benchmark decontamination by winnowing.

A text keeps, of every run of ``SPAN`` consecutive k-gram hashes, the smallest. Two texts that share
``K + SPAN - 1`` = 10 consecutive words keep a common hash there, so joining the kept hashes of texts and
benchmark items misses no shared window. Hits are then extended: the ten-word windows around a common hash
are compared word by word. Items of fewer words than a window are one window each and are looked up by the
hash of all their words, one pass for each such length that exists (at most nine).

All of it is built-in column functions and joins; which side of a join is broadcast is left to Spark, which
knows the exact size of the written fingerprint table.

Defined cases: null texts have no words; items without words never occur; repeated texts and items with one
id are each judged by their text; an item occurs once however often its windows do; empty tables give empty
results or no hits. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promoforge.llm.common import ascii_lower, fresh, let, text_key
from promoforge.session import written_once

WINDOW = 10
K = 5
SPAN = WINDOW - K + 1


def item_words(text: Column) -> Column:
    """ASCII letters and digits and everything outside ASCII make words; A-Z count as a-z."""
    # Only the first and the last part can be empty; trimming them off first would try each run of separators once for each place in it.
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", -1), "")


def grams(hashes: Column, k: int) -> Column:
    """Hash of every run of ``k`` word hashes; none if there are fewer."""
    return F.when(F.size(hashes) < k, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])))


def winnowed(gram_hashes: Column) -> Column:
    """The distinct smallest hashes of all runs of ``SPAN`` grams; none if there are fewer."""
    return F.when(F.size(gram_hashes) < SPAN, F.array().cast("array<bigint>")).otherwise(F.array_distinct(
        F.transform(F.sequence(F.lit(0), F.size(gram_hashes) - SPAN), lambda i: F.least(*[F.get(gram_hashes, i + j) for j in range(SPAN)]))))


def fingerprints(words: Column, short: list[int]) -> Column:
    """What a text is looked up by: winnowed hashes, and all grams of the lengths of short items."""
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.array_distinct(F.concat(
        let(grams(h, K), winnowed), *[grams(h, n) for n in short])))


def _first_gram(n: int):
    return lambda hashes: F.get(grams(hashes, n), F.lit(0))


def _placed(k: int):
    return lambda gram, at: F.struct(gram.alias("print"), F.lit(k).alias("k"), at.alias("at"))


def _windows(words: Column) -> Column:
    """Start, length and text of every window of an item; a short item is one window."""
    return F.when(F.size(words) == 0, F.array().cast("array<struct<start:int,n:int,said:string>>")).otherwise(let(
        F.least(F.size(words), F.lit(WINDOW)), lambda n: F.transform(
            F.sequence(F.lit(0), F.size(words) - n),
            lambda i: F.struct(i.alias("start"), n.alias("n"), F.array_join(F.slice(words, i + 1, n), " ").alias("said")))))


def _covered(hits: Column) -> Column:
    """Words inside any of the hits (start, n), which come sorted."""
    ends = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(hits, ends, lambda a, h: F.struct(
        F.greatest(a["end"], h["start"] + h["n"]).alias("end"),
        (a["total"] + F.greatest(F.lit(0), h["start"] + h["n"] - F.greatest(a["end"], h["start"]))).alias("total")))["total"]


def find_benchmark(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per text: id, ``key`` (see ``text_key``), n_words, n_hit, hits (start, n), item_ids sorted as strings."""
    wanted = items.select(F.col(item_id_col).cast("string").alias("item"), item_words(F.col(item_text_col)).alias("words"))
    index = written_once(wanted.select("item", F.explode(_windows(F.col("words"))).alias("w")).groupBy("w.said", "w.n").agg(
        F.sort_array(F.collect_set("item")).alias("items")), "benchmark-windows")
    short = sorted(r.n for r in index.where(F.col("n") < WINDOW).select("n").distinct().collect())  # at most nine lengths
    # The hash by which each window is found: its smallest gram, or for a short item all its words.
    said = F.split("said", " ")
    by = let(F.transform(said, lambda w: F.xxhash64(w)), lambda h: F.when(
        F.size(h) < WINDOW, F.xxhash64(*[F.lit(0)])).otherwise(F.array_min(grams(h, K))))
    for n in short:
        by = F.when(F.col("n") == n, let(F.transform(said, lambda w: F.xxhash64(w)), _first_gram(n))).otherwise(by)
    prints = written_once(index.select(by.alias("print"), "n").distinct(), "benchmark-prints")

    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    read = written_once(text.select("id", text_key(F.col("text")).alias("key"), item_words(F.col("text")).alias("words")).select(
        "id", "key", F.size("words").cast("long").alias("n_words"), fingerprints(F.col("words"), short).alias("prints")), "text-prints")
    # One copy of each text that holds a print of the benchmark.
    found = read.select("key", F.explode("prints").alias("print")).join(prints.select("print").distinct(), "print", "left_semi")
    keys = written_once(found.select("key").distinct(), "hit-texts")
    near = text.withColumn("key", text_key(F.col("text"))).join(keys, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    near = written_once(near.select("key", item_words(F.col("text")).alias("words")), "near-words")

    # Extend: every window that holds the gram of a hit, judged by its words.
    placed = near.select("key", let(F.transform("words", lambda w: F.xxhash64(w)), lambda h: F.concat(*[
        F.transform(grams(h, k), _placed(k)) for k in (K, *short)])).alias("g"))
    widths = prints.withColumn("k", F.when(F.col("n") < WINDOW, F.col("n")).otherwise(F.lit(K)))
    hit = placed.select("key", F.inline("g")).join(widths, ["print", "k"])
    starts = hit.select("key", "n", F.explode(F.when(F.col("n") == WINDOW, F.sequence(F.greatest(F.col("at") - SPAN + 1, F.lit(0)), F.col("at"))).otherwise(F.array("at"))).alias("start"))
    starts = starts.groupBy("key").agg(F.collect_set(F.struct("start", "n")).alias("starts"))
    spoken = near.join(starts, "key").select("key", F.explode(let(F.col("words"), lambda words: F.transform(
        F.filter("starts", lambda s: s["start"] + s["n"] <= F.size(words)),
        lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n"), F.array_join(F.slice(words, s["start"] + 1, s["n"]), " ").alias("said"))))).alias("w"))
    hits = spoken.select("key", "w.*").join(index, ["said", "n"]).groupBy("key").agg(
        F.sort_array(F.collect_set(F.struct("start", "n"))).alias("hits"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    hits = written_once(hits.select("key", "hits", "item_ids", _covered(F.col("hits")).alias("n_hit")), "benchmark-hits")
    return read.select("id", "key", "n_words").join(hits, "key", "left").select(
        "id", "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("hits", F.array().cast("array<struct<start:int,n:int>>")).alias("hits"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit, with their columns."""
    found = find_benchmark(docs, items, text_col, text_col, item_id_col, item_text_col)
    key = fresh("key")
    bad = found.where("n_hit > 0").select(F.col("key").alias(key)).distinct()
    return docs.join(bad, text_key(docs[text_col]) == bad[key], "left_anti")
