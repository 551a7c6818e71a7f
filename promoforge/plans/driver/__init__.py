"""Every operator as a query over the given tables."""

from importlib import import_module

MODULES = ("search_queries", "scalar_queries", "reconcile_queries", "report_queries", "extraction_queries", "card_queries", "leaflet_queries", "snapshot_queries", "reading_queries")


def _load():
    for module in MODULES:
        import_module(f"{__name__}.{module}")
    return import_module(f"{__name__}.registry")


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
