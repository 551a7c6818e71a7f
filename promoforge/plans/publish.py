"""Apply scans to a stored catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promoforge.operators import reconcile as R
from promoforge.operators.scan_fold import fold_scans, scans_in_turn
from promoforge.session import spent_after, written_once
from promoforge.sources.catalog import CatalogStore
from promoforge.sources.postings import Postings


def publish_scans(
    store: CatalogStore, incoming: DataFrame, scans: DataFrame, position: Sequence[Column], manifests: DataFrame | None = None,
    postings: Postings | None = None,
) -> DataFrame | None:
    """Commit what all ``scans`` of one batch leave, in one revision; returns the scan metrics, which the store holds as well.

    ``incoming`` names the scan of each offer (``scan_id``), unless each source has one scan. The scans of a source count in the order they were made. Only the shards of scanned
    sources are read and rewritten, and ``postings`` with them. Superseded and repeated scans change nothing; if none is left there is no new revision.
    """
    sources = store.read_sources()
    # A stream commits for years; what a commit writes on its way goes with it.
    with spent_after(store.spark):
        allowed = written_once(scans_in_turn(scans, sources), "allowed")
        touched = [r.shard for r in allowed.select(store.shard_column().alias("shard")).distinct().collect()]
        if not touched:
            return None
        kept, seen, verdicts = fold_scans(store.read(shards=touched), incoming, allowed, position, store.buckets)
        metrics = written_once(R.scan_metrics(verdicts), "metrics", keep=True)
        store.commit(R.sources_after(sources, verdicts, manifests), seen, kept, metrics, dealt=True)
        if postings is not None:
            postings.update(touched)
    return metrics


def publish(
    store: CatalogStore, incoming: DataFrame, scans: DataFrame, position: Sequence[Column], manifests: DataFrame | None = None,
) -> DataFrame | None:
    """As :func:`publish_scans`, for offers that do not name their scan: of several scans of one source the newest counts and the offers are taken to be its."""
    return publish_scans(store, incoming.drop("scan_id"), R.newest_scans(scans), position, manifests)
