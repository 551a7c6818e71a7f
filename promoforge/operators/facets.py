"""Category, period and total counts from one grouped aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promoforge.operators.predicates import period_of
from promoforge.values import CATEGORIES


def facet_matrix(rows: DataFrame) -> DataFrame:
    """Counts per (category, period): at most two rows per category, combined before the shuffle."""
    return rows.groupBy("category_id", period_of(F.col("temporal_status")).alias("period")).agg(
        F.count(F.lit(1)).alias("n")
    )


def facet_counts(rows: DataFrame, validity: str = "current", category_ids=()) -> DataFrame:
    """``(facet, key, n)`` with every category and period present.

    Categories are counted after the validity choice and before the category choice; periods
    after the category choice and before the validity choice; the total after both.
    """
    period_ok = F.lit(True) if validity == "all" else F.col("period") == validity
    category_ok = F.col("category_id").isin(*category_ids) if category_ids else F.lit(True)

    def cell(condition, facet, key):
        return F.when(condition, F.struct(F.lit(facet).alias("facet"), key.alias("key"), F.col("n").alias("n")))

    cells = facet_matrix(rows).select(
        F.inline(
            F.array_compact(
                F.array(
                    cell(period_ok, "category", F.col("category_id")),
                    cell(category_ok, "period", F.col("period")),
                    cell(period_ok & category_ok, "total", F.lit("all")),
                )
            )
        )
    )
    zeros = [("category", c) for c, _ in CATEGORIES] + [("period", "current"), ("period", "future"), ("total", "all")]
    literal = ", ".join(f"named_struct('facet', '{f}', 'key', '{k}', 'n', 0L)" for f, k in zeros)
    zero_rows = rows.sparkSession.range(1, numPartitions=1).select(F.expr(f"inline(array({literal}))"))
    return cells.unionByName(zero_rows).groupBy("facet", "key").agg(F.sum("n").alias("n"))
