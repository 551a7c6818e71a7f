"""Spark types of the offer model, the catalog and its side tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()
D = T.DoubleType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


UNIT_PRICE = T.DecimalType(18, 4)
QUANTITY = T.DecimalType(24, 9)

PACKAGE = _struct(
    ("raw_text", S), ("units_in_pack", L), ("quantity_per_unit", QUANTITY), ("quantity_unit", S),
    ("total_quantity", QUANTITY), ("quantity_basis", S),
)
PRICE = _struct(
    ("currency", S), ("advertised_amount_cents", L), ("basis", S), ("raw_text", S),
    ("published_unit_price", UNIT_PRICE), ("calculated_unit_price", UNIT_PRICE),
    ("unit_price_basis", S), ("calculation", S), ("previous_amount_cents", L),
)
CONDITIONS = _struct(
    ("status", S), ("loyalty_required", B), ("app_activation_required", B),
    ("minimum_pack_count", L), ("minimum_spend_cents", L), ("minimum_cost_cents", L), ("raw_text", S),
)
VALIDITY = _struct(
    ("timezone", S), ("start_at", TS), ("end_at_exclusive", TS), ("raw_text", S), ("evidence_level", S),
)
BENEFIT = _struct(
    ("currency", S), ("amount_cents", L), ("earning_minimum_spend_cents", L),
    ("redemption_minimum_spend_cents", L), ("earning_category", S), ("earning_validity", VALIDITY),
    ("redemption_validity", VALIDITY), ("maximum_vouchers_per_receipt", L),
    ("maximum_discount_cents", L), ("exclusions", S), ("redemption_instructions", S), ("raw_text", S),
)
SCOPE = _struct(("type", S), ("label", S), ("applicability", S))
EVIDENCE = _struct(
    ("capture_id", S), ("url", S), ("selector", S), ("product_id", S), ("scope_url", S),
    ("price_field", S), ("raw_price", S), ("raw_package", S), ("raw_text", S), ("raw_conditions", S),
    ("raw_benefit", S), ("description", S), ("method", S), ("validity_selector", S), ("page", I),
    ("bbox", T.ArrayType(D)), ("fields", T.MapType(S, S)),
)

OFFER = _struct(
    ("id", S), ("data_origin", S), ("offer_type", S), ("retailer_id", S), ("source_id", S),
    ("campaign_id", S), ("source_offer_id", S), ("target_ids", T.ArrayType(S)), ("title", S),
    ("title_normalized", S), ("brand", S), ("original_category", S), ("category_id", S),
    ("category_rule_id", S), ("classification_level", S), ("classification_version", S),
    ("tags", T.ArrayType(S)), ("package", PACKAGE), ("price", PRICE), ("benefit", BENEFIT),
    ("conditions", CONDITIONS), ("validity", VALIDITY), ("scope", SCOPE), ("quality", S),
    ("limitations", T.ArrayType(S)), ("evidence", EVIDENCE), ("parser_version", S),
    ("source_url", S), ("first_seen_at", TS), ("last_seen_at", TS), ("last_verified_at", TS),
    ("published_at", TS),
)
# A catalog row is an offer plus the reconciliation state.
STATE_FIELDS = (("withdrawn", B), ("missing_count", L), ("last_missing_at", TS))
CATALOG = T.StructType(OFFER.fields + _struct(*STATE_FIELDS).fields)

# One row per scan: what a source run saw and whether it saw everything.
SCAN = _struct(
    ("source_id", S), ("scan_id", S), ("scan_at", TS), ("completeness", S), ("extracted", L),
    ("quarantined", L), ("resources", L), ("failed_resources", L), ("campaign_ids", T.ArrayType(S)),
)
SOURCE = _struct(
    ("source_id", S), ("revision", L), ("last_requested", TS), ("last_attempt", TS),
    ("last_success", TS), ("next_allowed", TS), ("failures", L), ("state", S), ("message", S),
    ("completeness", S), ("last_scan_id", S), ("metrics", T.MapType(S, D)), ("last_error_code", S),
)
CAPTURE = _struct(
    ("capture_id", S), ("url", S), ("source_id", S), ("fetched_at", TS), ("sha256", S), ("body", S),
)
MANIFEST = _struct(
    ("source_id", S), ("retailer_id", S), ("name", S), ("source_type", S), ("parser_version", S),
    ("allowed_domains", T.ArrayType(S)), ("entry_urls", T.ArrayType(S)), ("audit_status", S),
    ("enabled", B), ("scope_type", S), ("scope_label", S), ("capabilities", T.ArrayType(S)),
    ("max_requests", L), ("min_interval_seconds", D), ("deadline_seconds", L),
    ("refresh_seconds", L), ("cooldown_seconds", L), ("suspend_on", T.ArrayType(L)),
    ("timeout_seconds", L), ("connector", S), ("selection_endpoint", S), ("max_catalog_pages", L),
    ("store_id", S), ("campaign_title_suffix", S), ("max_documents", L), ("accept_encoding", S),
)
WORDS = _struct(
    ("doc_id", S), ("page", I), ("pos", L), ("text", S), ("fontname", S), ("size", D), ("x0", D),
    ("x1", D), ("top", D), ("bottom", D),
)
RECTS = _struct(
    ("doc_id", S), ("page", I), ("x0", D), ("top", D), ("x1", D), ("bottom", D), ("filled", B),
)
RULES = _struct(
    ("doc_id", S), ("page", I), ("x0", D), ("x1", D), ("top", D), ("bottom", D),
)
