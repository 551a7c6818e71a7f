"""Toxicity by a weighted lexicon.

Texts are folded: lower case, look-alike letters of other scripts and full-width forms to their Latin letters, digits and signs
inside words to the letters they stand for. An Aho-Corasick automaton finds the lexicon's words and word beginnings and its exception
phrases; a hit inside an exception phrase does not count. The weights of the hits, damped for repeats, are set against the length
of the text, and a logistic curve fitted on labelled texts turns the two figures into a score.

The lexicon is learned: words and word beginnings that are common in texts labelled toxic and rare in others, weighted by
smoothed log odds. Phrases of a hit and its neighbour that labelled clean texts use become exceptions. Learning takes at most
``MAX_LABELLED`` labelled texts, those with the smallest hash of their id; every text is scored. Lexicon and exceptions are broadcast
and have at most ``max_terms`` entries each, those of most texts; the model says how many were left out (``cut``).

Defined cases: null and empty texts hold no hit and get the score of such texts; labels that are null or without a text teach
nothing, of repeated labels of an id the largest counts; equal texts teach once; without texts of both labels every score
is zero; empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promoforge.llm.common import text_key
from promoforge.session import written_once

MAX_LABELLED, MAX_TERMS = 20_000, 5_000
# A term needs this share of the toxic texts, at least so many of them, and this share of its texts toxic.
MIN_SHARE, MIN_TEXTS, MIN_PRECISION = 0.025, 4, 0.9
BEGINNINGS = range(4, 9)
THRESHOLD = 0.7
# Letters that look like Latin ones, and signs used for letters inside words.
LOOKALIKES = str.maketrans({
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y",
    "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ɑ": "a",
    "ı": "i", "ɪ": "i", "օ": "o", "һ": "h", "ո": "n", "ս": "u", "ɡ": "g", "ʏ": "y", "ᴀ": "a", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ᴋ": "k", "ᴍ": "m", "ᴏ": "o", "ᴘ": "p", "ᴛ": "t", "ᴜ": "u"})
SIGNS = str.maketrans("013457@$!|€", "oieastasiie")
# Beyond ASCII and common accented letters: what may be a disguise.
_FOREIGN = re.compile("[^\x00-\x7f\u00c0-\u012f\u0132-\u017f]")
_HIDDEN = re.compile("[​-‍­⁠﻿]")
# A run of letters that signs go on in, from its start; or one sign at the start of a word.
_DISGUISED = re.compile(r"(?<![^\W_0-9])[^\W_0-9]++(?:[0-9@$!|€]++[^\W_0-9]++)+|(?<!\S)[0-9@$|€](?=[^\W_0-9])(?:[0-9@$!|€]*+[^\W_0-9]++)+")
_WORD = re.compile(r"[^\W_0-9]{3,40}")


def fold(text: str) -> str:
    """Lower case without disguise."""
    text = text.lower()
    if _FOREIGN.search(text):
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text)).lower().translate(LOOKALIKES)
    return _DISGUISED.sub(lambda m: m[0].translate(SIGNS), text)


class Lexicon:
    """Automaton of terms (``word`` or ``beginning*``) with weights, and of exception phrases."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        self.weights = weights
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list] = {}
        for term in weights:
            found.setdefault(term.rstrip("*"), []).append(term)
        for phrase in exceptions:
            found.setdefault(phrase, []).append(None)
        for plain, what in found.items():
            self.automaton.add_word(plain, (len(plain), what))
        self.empty = not found
        if found:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, str]]:
        """(start, end, term) of the hits that no exception phrase covers; terms start at the start of a word."""
        if self.empty:
            return []
        hits, spared, size = [], [], len(folded)
        for last, (length, what) in self.automaton.iter(folded):
            start, end = last + 1 - length, last + 1
            if start and folded[start - 1].isalpha():
                continue
            closed = end == size or not folded[end].isalpha()
            for term in what:
                if term is None:
                    if closed:
                        spared.append((start, end))
                elif closed or term[-1] == "*":
                    hits.append((start, end, term))
        if not spared:
            return hits
        # Of the phrases that start no later than a hit, the one that reaches farthest.
        spared.sort()
        starts, ends = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
        return [h for h in hits if not (k := bisect_right(starts, h[0])) or ends[k - 1] < h[1]]

    def figures(self, text: str | None) -> tuple[float, float]:
        """Weight of the hits in units of the strongest single hit, up to one; and weight by the length of the text."""
        folded = fold(text or "")
        counts = Counter(term for _, _, term in self.hits(folded))
        weight = sum(self.weights[t] * (1 + math.log2(n)) for t, n in counts.items())
        most = max(self.weights.values(), default=1.0)
        return min(1.0, weight / (0.5 * most)), weight / math.log(math.e + len(folded.split()))


def _terms(text: str) -> set[str]:
    words = set(_WORD.findall(fold(text)))
    return words | {w[:k] + "*" for w in words for k in BEGINNINGS if len(w) >= k}


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update(_terms(text.as_py() or ""))
        # Terms of clean texts alone cannot become lexicon terms in this batch, but count against others.
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()),
                                          pa.array([counts[0][t] for t in terms], pa.int64())], ["term", "toxic", "clean"])


def choose_terms(counts: dict[str, tuple[int, int]], toxic: int, clean: int, most: int = MAX_TERMS) -> tuple[dict[str, float], int]:
    """Weights of the terms chosen from ``counts`` (toxic texts, clean texts): a beginning where many words
    share it, else the word; nothing that extends a chosen beginning. And how many beyond ``most`` were left out."""
    good = {t: c for t, c in counts.items() if c[0] >= max(MIN_TEXTS, MIN_SHARE * toxic) and c[0] >= MIN_PRECISION * (c[0] + c[1])}
    words = [t for t in good if t[-1] != "*"]
    best: dict[str, int] = {}
    for w in words:
        for k in BEGINNINGS:
            best[w[:k]] = max(best.get(w[:k], 0), good[w][0])
    chosen: list[str] = []
    for t in sorted(good, key=lambda t: (t[-1] != "*", len(t), t)):
        plain = t.rstrip("*")
        if any(plain.startswith(c[:-1]) for c in chosen if c[-1] == "*"):
            continue
        if t[-1] != "*" or best.get(plain, 0) < 0.8 * good[t][0]:
            chosen.append(t)
    def odds(c):
        return math.log((c[0] + 0.5) / (toxic + 1)) - math.log((c[1] + 0.5) / (clean + 1))

    chosen.sort(key=lambda t: (-good[t][0], t))
    return {t: odds(good[t]) for t in chosen[:most]}, max(0, len(chosen) - most)


@lru_cache(maxsize=4)
def _lexicon(shared) -> Lexicon:
    return Lexicon(*shared.value)


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression with intercept by Newton steps; both labels weigh the same."""
    x = np.column_stack((np.ones(len(x)), x))
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    theta, pull = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + pull, x.T @ (weight * (y - p)) - pull @ theta)
        theta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return theta


class ToxicityModel:
    """Weights of terms, exception phrases, curve, and how many terms and phrases the bound left out when it was learned."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], theta: list[float] | None, cut: tuple[int, int] = (0, 0)):
        self.weights, self.exceptions, self.theta, self.cut = weights, exceptions, theta, cut

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per text: id, score (0 to 1) and ``hits`` (start, end in folded characters, term)."""
        shared, theta = docs.sparkSession.sparkContext.broadcast((self.weights, self.exceptions)), self.theta

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon = _lexicon(shared)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string())]))
            for batch in batches:
                scores, hits = [], []
                for value in batch.column("text"):
                    text = value.as_py() or ""
                    a, b = lexicon.figures(text)
                    scores.append(0.0 if theta is None else 1 / (1 + math.exp(-max(-30.0, min(30.0, theta[0] + theta[1] * a + theta[2] * b)))))
                    hits.append([{"start": s, "end": e, "term": t} for s, e, t in lexicon.hits(fold(text))] if b else [])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64()), pa.array(hits, kind)], ["id", "score", "hits"])

        text = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
        return text.mapInArrow(run, f"id {text.schema['id'].dataType.simpleString()}, score double, hits array<struct<start:int,end:int,term:string>>")


def learn_toxicity(docs: DataFrame, labels: DataFrame, teaches: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   max_terms: int = MAX_TERMS) -> ToxicityModel:
    """Lexicon, exceptions and curve from the labelled texts; ``teaches`` says which labels (by their columns) may be used."""
    given = labels.where(teaches & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    given = given.groupBy(F.col(id_col).alias("lid")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    given = given.orderBy(F.xxhash64("lid"), "lid").limit(MAX_LABELLED)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    sample = texts.join(given, F.col("id") == F.col("lid")).groupBy(text_key(F.col("text")).alias("key")).agg(
        F.first("text").alias("text"), F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    sample = written_once(sample.select("text", "toxic"), "labelled")
    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return ToxicityModel({}, [], None)
    counts = sample.mapInArrow(_term_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # Each text holds a bounded share of the terms, so those common enough are few.
    common = counts.where((F.col("toxic") >= max(MIN_TEXTS, MIN_SHARE * toxic)) & (F.col("toxic") >= MIN_PRECISION * (F.col("toxic") + F.col("clean"))))
    weights, terms_cut = choose_terms({r.term: (r.toxic, r.clean) for r in common.collect()}, toxic, clean, max_terms)

    plain = sample.sparkSession.sparkContext.broadcast((weights, []))

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(plain)
        for batch in batches:
            found: list[tuple[str, int]] = []
            for value, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                folded, mine = fold(value.as_py() or ""), set()
                for start, end, _ in lexicon.hits(folded):
                    while end < len(folded) and folded[end].isalpha():
                        end += 1
                    before, after = re.search(r"[^\W_0-9]+ $", folded[max(0, start - 41):start]), re.match(r" [^\W_0-9]+", folded[end:end + 41])
                    mine |= {folded[start - len(before[0]):end]} if before else set()
                    mine |= {folded[start:end + len(after[0])]} if after else set()
                found += [(p, label) for p in mine]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32())], ["phrase", "toxic"])

    spared = sample.mapInArrow(phrases, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    spared = spared.where((F.col("n") - F.col("toxic") >= 3) & (10 * F.col("toxic") <= F.col("n")))
    spared = written_once(spared, "exceptions")
    exceptions = [r.phrase for r in spared.orderBy(F.desc("n"), "phrase").limit(max_terms).collect()]
    cut = terms_cut, max(0, spared.count() - max_terms)

    whole = sample.sparkSession.sparkContext.broadcast((weights, exceptions))

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(whole)
        for batch in batches:
            pairs = [lexicon.figures(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.float64()), pa.array([p[1] for p in pairs], pa.float64()), batch.column("toxic")], ["a", "b", "toxic"])

    rows = sample.mapInArrow(figures, "a double, b double, toxic int").groupBy("a", "b", "toxic").count().toPandas().sort_values(["a", "b", "toxic"])
    spread = np.repeat(np.arange(len(rows)), rows["count"])
    theta = _fit(rows[["a", "b"]].to_numpy()[spread], rows["toxic"].to_numpy(float)[spread])
    return ToxicityModel(weights, exceptions, theta.tolist(), cut)
