"""Source manifests: JSON files checked before anything uses them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promoforge.functions.quality import reasons
from promoforge.schemas import MANIFEST
from promoforge.values import ADMITTED_AUDITS, CONNECTORS

AUDITS = ("candidate", "verified_supported", "partial", "blocked_access", "permission_required", "unsupported_format", "disabled")
REQUIRED = ("source_id", "retailer_id", "name", "source_type", "parser_version", "allowed_domains", "entry_urls", "audit_status",
            "enabled", "scope_type", "scope_label", "capabilities", "max_requests", "min_interval_seconds", "deadline_seconds",
            "refresh_seconds", "cooldown_seconds", "suspend_on", "timeout_seconds")


def violations() -> Column:
    """Names of the admission rules a manifest breaks."""
    col = F.col

    def outside(name: str, low=None, high=None) -> tuple[str, Column]:
        bad = F.lit(False)
        if low is not None:
            bad = bad | (col(name) < low)
        if high is not None:
            bad = bad | (col(name) > high)
        return name, bad

    missing = F.lit(False)
    for name in REQUIRED:
        missing = missing | col(name).isNull()
    absent = lambda name: F.coalesce(F.length(name), F.lit(0)) == 0
    return reasons(
        ("missing", missing),
        ("source_type", ~col("source_type").isin("html", "text_pdf")),
        ("audit_status", ~col("audit_status").isin(*AUDITS)),
        ("scope_type", ~col("scope_type").isin("national", "regional", "store", "online")),
        ("connector", ~col("connector").isin(*CONNECTORS)),
        outside("max_requests", 1, 60), outside("min_interval_seconds", 3), outside("deadline_seconds", 1, 180),
        outside("refresh_seconds", 43_200), outside("cooldown_seconds", 1_800), outside("timeout_seconds", high=30),
        outside("max_catalog_pages", 1, 40), outside("max_documents", 1, 3),
        ("accept_encoding", ~col("accept_encoding").isin("gzip, deflate", "identity")),
        ("audit", col("enabled") & ~col("audit_status").isin(*ADMITTED_AUDITS)),
        ("campaign_scope", (col("connector") == "rect_cells") & (absent("store_id") | absent("campaign_title_suffix"))),
        ("store_form", (col("connector") == "store_paged") & (absent("store_id") | absent("selection_endpoint"))),
    )


def with_defaults(manifests: DataFrame) -> DataFrame:
    """Fill what a manifest may leave out."""
    defaults = {"max_catalog_pages": 20, "max_documents": 2, "accept_encoding": "gzip, deflate"}
    return manifests.fillna(defaults)


def switch_off(manifests: DataFrame, disabled: Sequence[str]) -> DataFrame:
    """Manifests with the named sources disabled."""
    return manifests.withColumn("enabled", F.col("enabled") & ~F.col("source_id").isin(*disabled)) if disabled else manifests


def load_manifests(spark: SparkSession, folder: str, disabled: Sequence[str] = ()) -> DataFrame:
    """All manifests of a folder, in file order; one that breaks a rule fails the load."""
    rows = spark.read.schema(MANIFEST).json(f"{folder}/*.json", multiLine=True, mode="FAILFAST")
    rows = with_defaults(rows.withColumn("file_order", F.col("_metadata.file_name")))
    broken = rows.select("source_id", violations().alias("v")).where(F.size("v") > 0).take(1)
    if broken:
        raise ValueError(f"manifest {broken[0].source_id}: {', '.join(broken[0].v)}")
    return switch_off(rows, disabled)
