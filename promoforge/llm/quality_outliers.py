"""Quality rules: robust multivariate outliers by minimum covariance determinant.

A text gets base counts and two plain limits. What passes them is judged by the Mahalanobis distance
of four transformed statistics from the minimum-covariance-determinant estimate of its language and
source. Everything runs as built-in column functions and aggregates.

Defined cases: a null or blank text has no words and fails the base limits; rows are judged one by one,
so repeated rows get the same verdict; null languages and sources form groups of their own; a group of
fewer than ``min_group`` fitting texts is judged by its language's estimate, that by the estimate of all
texts, and with too few texts in all only the base limits hold; an empty table gives an empty result.
Only the named columns are read, so other columns of any name do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promoforge.llm.common import blank_words, code_points, fresh, let, text_key
from promoforge.session import written_once

STATS = ("word_length", "symbols", "line_copies", "repeats")
# Standard deviation below which a difference in a statistic is not held against a text.
FLOORS = (0.03, 0.05, 0.1, 0.1)
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
# Median and 97.5 % point of the chi-square distribution with four degrees of freedom.
CHI2_MEDIAN, CHI2_REWEIGHT = 3.3567, 11.1433
# Squared distance beyond which a text is rejected (a chi-square tail of about 4e-10).
CUTOFF = 50.0
# Levels up to which a table of them is broadcast.
BROADCAST_LEVELS = 20_000
# Weight of the prior that steadies the statistics of short texts, in words and in lines.
PRIOR_WORDS, PRIOR_LINES, PRIOR_LENGTH = 50, 5, 5
SYMBOLS = "#*$%&|<>"


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words inside a ``width``-word window that the text holds twice or more."""

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
        return let(pairs, lambda s: let(
            F.transform(F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["v"] == x["v"], F.lit(False))
                                 | F.coalesce(F.get(s, i + 1)["v"] == x["v"], F.lit(False))), lambda x: x["i"]),
            lambda p: let(F.sort_array(p), lambda q: F.aggregate(
                F.transform(q, lambda v, i: F.least(F.lit(width), F.coalesce(F.get(q, i + 1) - v, F.lit(width)))),
                F.lit(0).cast("long"), lambda a, v: a + v))))

    def counted(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - width),
                              lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))
        return let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))

    return F.when(F.size(words) < width, F.lit(0).cast("long")).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), counted))


def base_counts(text: Column) -> Column:
    """Struct of the base counts of one text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike("[^ \\t-\\r]"))
    return let(blank_words(whole), lambda words: let(lines, lambda kept: F.struct(
        F.size(words).cast("long").alias("n_words"),
        code_points(F.translate(whole, " \t\n\x0b\f\r", "")).alias("word_chars"),
        (F.char_length(whole) - F.char_length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(kept).cast("long").alias("n_lines"),
        (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"))))


def _statistics() -> list[Column]:
    n = F.col("n_words") + PRIOR_WORDS
    return [
        F.log((F.col("word_chars") + PRIOR_WORDS * PRIOR_LENGTH) / n),
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + PRIOR_LINES)),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution through the Cholesky factor."""
    solved: list[Column] = []
    for i, name in enumerate(STATS):
        rest = F.col(name) - F.col(f"m{i}")
        for j, y in enumerate(solved):
            rest = rest - F.col(f"l{i}{j}") * y
        solved.append(rest / F.col(f"l{i}{i}"))
    total = solved[0] * solved[0]
    for y in solved[1:]:
        total = total + y * y
    return total


def _moments() -> list[Column]:
    size = range(len(STATS))
    return [F.count(F.lit(1)).alias("fitted"), *[F.avg(STATS[i]).alias(f"m{i}") for i in size],
            *[F.covar_pop(STATS[i], STATS[j]).alias(f"s{i}{j}") for i in size for j in range(i + 1)]]


def _factored(moments: DataFrame, scale: Column) -> DataFrame:
    """Cholesky factor of the scaled covariance plus the squared floors."""
    out, size = moments, range(len(STATS))
    for i in size:
        for j in range(i + 1):
            rest = F.col(f"s{i}{j}") * scale
            if i == j:
                rest = rest + FLOORS[i] ** 2
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.select("level", "fitted", *[f"m{i}" for i in size], *[f"l{i}{j}" for i in size for j in range(i + 1)])


def _grid(value: Column) -> Column:
    """Values on a grid of thousandths: an exact median then keeps few distinct values per group."""
    return F.round(value, 3)


def _beside(rows: DataFrame) -> DataFrame:
    """A written table with a row per level, to be joined to many rows: broadcast if the count shows that it is small
    (25 numbers a row, so a few MB at most), else left to Spark's joins, which split hot keys."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_LEVELS else rows


def mcd_estimates(vectors: DataFrame, steps: int = 3, min_group: int = 50) -> DataFrame:
    """Location and Cholesky factor of each ``level`` (column) from the columns ``STATS``.

    Concentration steps: distances from the present estimate, the nearer half of every level, the moments of
    that half. The start is coordinatewise medians and absolute deviations; the end is the usual
    consistency factor and one reweighting. Levels with fewer than ``min_group`` vectors are left out.
    """
    size = range(len(STATS))
    centre = vectors.groupBy("level").agg(F.count(F.lit(1)).alias("fitted"), *[F.median(_grid(F.col(s))).alias(f"m{i}") for i, s in enumerate(STATS)])
    centre = _beside(written_once(centre.where(F.col("fitted") >= min_group), "mcd-centre"))
    spread = vectors.join(centre, "level").groupBy("level").agg(
        F.first("fitted").alias("fitted"), *[F.first(f"m{i}").alias(f"m{i}") for i in size],
        *[F.median(_grid(F.abs(F.col(STATS[i]) - F.col(f"m{i}")))).alias(f"d{i}") for i in size])
    start = spread.select("level", "fitted", *[f"m{i}" for i in size], *[
        (F.pow(F.col(f"d{i}") * 1.4826, 2) if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i in size for j in range(i + 1)])
    estimate = _beside(written_once(_factored(start, F.lit(1.0)), "mcd-start"))
    for step in range(steps):
        near = vectors.join(estimate, "level").withColumn("d2", _distance())
        half = _beside(written_once(near.groupBy("level").agg(F.median(_grid(F.log1p("d2"))).alias("half")), f"mcd-half{step}"))
        kept = near.join(half, "level").where(_grid(F.log1p("d2")) <= F.col("half"))
        estimate = _beside(written_once(_factored(kept.groupBy("level").agg(*_moments()), F.lit(1.0)), f"mcd-step{step}"))
    near = vectors.join(estimate, "level").withColumn("d2", _distance())
    half = _beside(written_once(near.groupBy("level").agg(F.median(_grid(F.log1p("d2"))).alias("half")), "mcd-factor"))
    # The nearer half understates the covariance; the median distance says by how much.
    factor = F.greatest(F.lit(1.0), F.expm1("half") / CHI2_MEDIAN)
    kept = near.join(half, "level").where(F.col("d2") <= CHI2_REWEIGHT * factor)
    return written_once(_factored(kept.groupBy("level").agg(*_moments()), F.lit(1.0)), "mcd-final")


def _levels() -> Column:
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("?"))
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("?"))
    return F.array(F.to_json(F.array(lang, source)), F.to_json(F.array(lang)), F.lit("[]"))


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source", cutoff: float = CUTOFF, min_group: int = 50) -> DataFrame:
    """One row per text: id, ``key`` (see ``text_key``), language, source, the base counts, ``base_failed``, ``distance`` and ``kept``."""
    counted = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(lang_col).cast("string").alias("lang"),
                          F.col(source_col).cast("string").alias("source"), base_counts(F.col(text_col)).alias("c"))
    counted = counted.select("id", "key", "lang", "source", "c.*")
    counted = counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                                 | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    counted = written_once(counted.select("*", *[c.alias(s) for c, s in zip(_statistics(), STATS, strict=True)]), "quality-counts")
    vectors = counted.where(~F.col("base_failed")).select(F.explode(_levels()).alias("level"), *STATS)
    estimates = mcd_estimates(vectors, min_group=min_group)
    # The finest level that has an estimate: one small list of estimates with the levels they serve.
    levels = written_once(counted.select(_levels().alias("levels")).distinct().select(
        F.col("levels")[0].alias("own"), F.posexplode("levels").alias("rank", "level")), "quality-levels")
    best = levels.join(estimates, "level").groupBy("own").agg(F.min_by(F.struct(*[c for c in estimates.columns if c != "level"]), "rank").alias("e"))
    best = _beside(written_once(best.select("own", "e.*"), "quality-best"))
    judged = counted.withColumn("own", _levels()[0]).join(best, "own", "left").withColumn("distance", _distance())
    return judged.select("id", "key", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
                         (~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)).alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns; repeated rows stay repeated."""
    verdicts = judge_quality(docs, id_col, text_col, lang_col, source_col).where("kept")
    key, lang, source = fresh("key"), fresh("lang"), fresh("source")
    good = verdicts.select(F.col("key").alias(key), F.col("lang").alias(lang), F.col("source").alias(source)).distinct()
    same = (text_key(docs[text_col]) == good[key]) & docs[lang_col].cast("string").eqNullSafe(good[lang]) & docs[source_col].cast("string").eqNullSafe(good[source])
    return docs.join(good, same, "left_semi")
