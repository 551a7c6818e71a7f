"""Search, vouchers, lookups and pickers over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from promoforge.operators import predicates as P
from promoforge.operators import targets
from promoforge.operators.ranking import page
from promoforge.plans.driver.registry import query
from promoforge.plans.driver.views import (
    NOW,
    NOW_SQL,
    STATES_SQL,
    catalog,
    now,
    table,
)
from promoforge.plans.search import SearchRequest, candidates, facets, result_page, selected, stored_page
from promoforge.schemas import SOURCE
from promoforge.session import work_path
from promoforge.sources.catalog import CatalogStore
from promoforge.sources.postings import Postings
from promoforge.values import CATEGORIES

CATEGORY_VALUES = ", ".join(f"('{c}')" for c, _ in CATEGORIES)


@query("temporal_freshness", f"WITH {STATES_SQL} SELECT listing_id, temporal_status, freshness FROM states")
def temporal_freshness(spark, sf_dir):
    """P1, P2 on every listing."""
    rows = P.with_time_states(catalog(spark, sf_dir), now())
    return rows.select(F.col("id").alias("listing_id"), "temporal_status", "freshness")


@query("visible_products", f"""WITH {STATES_SQL}
SELECT category_id, period, is_voucher, count(*) AS n FROM visible GROUP BY ALL""")
def visible_products(spark, sf_dir):
    """Visible rows split into products and vouchers."""
    rows = P.with_time_states(catalog(spark, sf_dir).where(P.visible_at(now())), now())
    return rows.groupBy(
        "category_id", P.period_of(F.col("temporal_status")).alias("period"), P.is_voucher().alias("is_voucher")
    ).agg(F.count(F.lit(1)).alias("n"))


def facet_sql(where: str, validity: str, categories: tuple[str, ...]) -> str:
    period_ok = "true" if validity == "all" else f"period = '{validity}'"
    category_ok = "category_id IN ({})".format(", ".join(f"'{c}'" for c in categories)) if categories else "true"
    return f"""WITH {STATES_SQL}, hits AS (SELECT * FROM visible WHERE NOT is_voucher AND {where})
SELECT 'category' AS facet, c.id AS key, (SELECT count(*) FROM hits WHERE category_id = c.id AND {period_ok}) AS n
FROM (VALUES {CATEGORY_VALUES}) c(id)
UNION ALL SELECT 'period', p.id, (SELECT count(*) FROM hits WHERE period = p.id AND {category_ok})
FROM (VALUES ('current'), ('future')) p(id)
UNION ALL SELECT 'total', 'all', (SELECT count(*) FROM hits WHERE {period_ok} AND {category_ok})"""


@query("search_facets", facet_sql("true", "current", ("carne", "pesce", "altri")))
def search_facets(spark, sf_dir):
    """A1-A3 with a category choice: categories ignore it, periods and total do not."""
    return facets(catalog(spark, sf_dir), SearchRequest(NOW, category_ids=("carne", "pesce", "altri")))


@query("search_facets_filtered", facet_sql(
    "loyalty_required IS NULL AND basis = 'kg' AND coalesce(minimum_pack_count, 1) <= 1", "all", ()))
def search_facets_filtered(spark, sf_dir):
    """P7 and P9 take rows out of both facets."""
    request = SearchRequest(NOW, validity="all", loyalty="unknown", sort="price", price_basis="kg")
    return facets(catalog(spark, sf_dir), request)


def page_sql(where: str, order: str, limit: int, offset: int = 0) -> str:
    return f"""WITH {STATES_SQL}, hits AS (SELECT * FROM visible WHERE NOT is_voucher AND {where}),
placed AS (SELECT *, row_number() OVER (ORDER BY {order}) AS place, count(*) OVER () AS hits FROM hits)
SELECT listing_id, amount_cents, CAST(epoch(end_at_exclusive) AS BIGINT) AS end_s, place AS rank,
       hits > {offset + limit} AS has_more
FROM placed WHERE place > {offset} AND place <= {offset + limit}"""


def page_columns(rows):
    return rows.select(
        F.col("id").alias("listing_id"), F.col("price.advertised_amount_cents").alias("amount_cents"),
        F.unix_seconds("validity.end_at_exclusive").alias("end_s"), F.col("rank").cast("bigint").alias("rank"),
        "has_more",
    )


@query("search_price", page_sql("basis = 'kg' AND coalesce(minimum_pack_count, 1) <= 1 AND period = 'current'",
                                "amount_cents, listing_id", 24))
def search_price(spark, sf_dir):
    """comparable prices per kilogram, cheapest first."""
    return page_columns(result_page(catalog(spark, sf_dir), SearchRequest(NOW, sort="price", price_basis="kg")))


@query("search_expiry", page_sql("minimum_pack_count >= 2 AND loyalty_required AND period = 'current'",
                                 "end_at_exclusive NULLS LAST, listing_id", 24))
def search_expiry(spark, sf_dir):
    """F2 with P7 and P8: loyalty offers needing several packs, first to end first."""
    request = SearchRequest(NOW, sort="expiry", loyalty="required", minimum_quantity="required")
    return page_columns(result_page(catalog(spark, sf_dir), request))


@query("search_relevance", page_sql(
    "list_bool_and([len(list_filter(string_split(lower(title || ' ' || brand), ' '), lambda w: starts_with(w, t))) > 0"
    " for t in ['red', 'med']])",
    "CASE WHEN title = 'red med' THEN 0 WHEN starts_with(title, 'red med') THEN 1 ELSE 2 END, listing_id", 50))
def search_relevance(spark, sf_dir):
    """F3 with P6: keyword search, titles starting with the query first."""
    request = SearchRequest(NOW, sort="relevance", query="  RED  mèd ", validity="all", limit=50)
    return page_columns(result_page(catalog(spark, sf_dir), request))


@query("search_recent", page_sql("period = 'future' AND category_id IN ('pesce', 'dolci')",
                                 "start_at DESC, listing_id DESC", 30, 60))
def search_recent(spark, sf_dir):
    """third page of the default order among coming offers of two categories."""
    request = SearchRequest(NOW, validity="future", category_ids=("pesce", "dolci"), limit=30, offset=60)
    return page_columns(result_page(catalog(spark, sf_dir), request))


RED_MED = ("list_bool_and([len(list_filter(string_split(lower(title || ' ' || brand), ' '), lambda w: starts_with(w, t))) > 0 for t in ['red', 'med']])",
           "CASE WHEN title = 'red med' THEN 0 WHEN starts_with(title, 'red med') THEN 1 ELSE 2 END, listing_id")
TARGETS = ("src-1", "src-2", "src-3", "src-5", "src-8")
# Where and in which order the pages of the stored catalog are taken.
STORED_PAGES = {
    "price": ("basis = 'kg' AND coalesce(minimum_pack_count, 1) <= 1 AND period = 'current'", "amount_cents, listing_id", 24, 0),
    "words": (*RED_MED, 50, 0),
    "long words": ("period = 'current' AND contains(' ' || lower(title || ' ' || brand), ' burnished') AND contains(' ' || lower(title || ' ' || brand) || ' ', ' economy')",
                   "listing_id", 24, 0),
    "targets": (f"source_id IN {TARGETS} AND retailer_id IN ('ret-1', 'ret-2', 'ret-4', 'ret-7', 'ret-9', 'ret-15') AND period = 'current'", "start_at DESC, listing_id DESC", 24, 0),
    "second recent": ("period = 'current'", "start_at DESC, listing_id DESC", 20, 20),
    "second expiry": ("period = 'current'", "end_at_exclusive NULLS LAST, listing_id", 20, 20),
    "nothing": ("false", "listing_id", 24, 0),
}


@query("stored_pages", " UNION ALL ".join(f"SELECT '{name}' AS page, * FROM ({page_sql(*sql)})" for name, sql in STORED_PAGES.items()))
def stored_pages(spark, sf_dir):
    """Pages of a stored catalog fetched late, by postings, of targets and retailers, and behind a key."""
    store = CatalogStore(spark, work_path(spark, "catalog"), shards=8, buckets=4)
    store.commit(spark.createDataFrame([], SOURCE), catalog(spark, sf_dir))
    postings = Postings(store)
    postings.update(range(store.shards))

    def behind(**asked):
        """The page after the first one, by the key of its last row."""
        first = stored_page(store, SearchRequest(NOW, limit=20, **asked)).orderBy(F.desc("rank")).first()
        key = {"id": first.id, "first_seen_at": first.first_seen_at, "end_at_exclusive": first.validity.end_at_exclusive}
        rows = stored_page(store, SearchRequest(NOW, limit=20, after=key, **asked))
        return rows.withColumn("rank", F.col("rank") + 20)

    pages = {
        "price": stored_page(store, SearchRequest(NOW, sort="price", price_basis="kg")),
        "words": stored_page(store, SearchRequest(NOW, sort="relevance", query="  RED  mèd ", validity="all", limit=50), postings),
        "long words": stored_page(store, SearchRequest(NOW, sort="relevance", query="burnished economy"), postings),
        "targets": stored_page(store, SearchRequest(NOW, targets=TARGETS, retailer_ids=("ret-1", "ret-2", "ret-4", "ret-7", "ret-9", "ret-15"))),
        "second recent": behind(), "second expiry": behind(sort="expiry"),
        "nothing": stored_page(store, SearchRequest(NOW, sort="relevance", query="nowhere"), postings)}
    parts = [page_columns(rows).withColumn("page", F.lit(name)) for name, rows in pages.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query("search_selection", f"""WITH {STATES_SQL}
SELECT retailer_id, category_id, count(*) AS n, sum(amount_cents)::BIGINT AS cents FROM visible
WHERE NOT is_voucher AND period = 'current' GROUP BY ALL""")
def search_selection(spark, sf_dir):
    """Everything a default search selects, per retailer and category."""
    return selected(catalog(spark, sf_dir), SearchRequest(NOW)).groupBy("retailer_id", "category_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("price.advertised_amount_cents").alias("cents")
    )


def choice_counts(name: str, column: str, conditions: dict[str, str]):
    cases = " UNION ALL ".join(
        f"SELECT '{choice}' AS choice, category_id, count(*) AS n FROM visible WHERE NOT is_voucher AND {sql} GROUP BY ALL"
        for choice, sql in conditions.items()
    )

    @query(name, f"WITH {STATES_SQL} {cases}")
    def counts(spark, sf_dir):
        rows = candidates(catalog(spark, sf_dir), SearchRequest(NOW))
        test = P.loyalty_is if column == "loyalty" else P.minimum_quantity_is
        choices = F.array_compact(F.array(*[F.when(test(c), F.lit(c)) for c in conditions]))
        return rows.select("category_id", F.explode(choices).alias("choice")).groupBy("choice", "category_id").agg(
            F.count(F.lit(1)).alias("n")
        )


choice_counts("tristate_loyalty", "loyalty", {
    "all": "true", "required": "loyalty_required IS true", "not_required": "loyalty_required IS false",
    "unknown": "loyalty_required IS NULL",
})
choice_counts("min_quantity", "minimum_quantity", {
    "all": "true", "required": "minimum_pack_count >= 2", "not_required": "minimum_pack_count = 1",
    "unknown": "minimum_pack_count IS NULL",
})


@query("keyword_documents", """WITH folded AS (
  SELECT doc_id, trim(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '\\s+', ' ', 'g')) AS plain FROM documents),
bags AS (SELECT doc_id, string_split(plain, ' ') AS bag FROM folded)
SELECT doc_id FROM bags
WHERE len(list_filter(bag, lambda w: starts_with(w, 'eau'))) > 0
  AND len(list_filter(bag, lambda w: w = 'le')) > 0 AND len(list_filter(bag, lambda w: starts_with(w, 'ele'))) > 0""")
def keyword_documents(spark, sf_dir):
    """P6 on whole texts: prefixes of three letters, shorter words only as a whole."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("title"), F.lit("").alias("brand"))
    return docs.where(P.keyword_match(["eau", "le", "ele"])).select("doc_id")


@query("point_lookup", f"""WITH {STATES_SQL}, asked AS (
  SELECT DISTINCT l_orderkey || '-1-' || l_partkey || '-' || l_suppkey AS asked_id FROM lineitem)
SELECT asked_id, temporal_status, freshness, withdrawn FROM asked JOIN states ON listing_id = asked_id
WHERE quality <> 'quarantined'""")
def point_lookup(spark, sf_dir):
    """P12, P19 for a table of ids: quarantined rows are not found, expired and withdrawn ones are."""
    asked = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", F.lit("1"), "l_partkey", "l_suppkey").alias("asked_id")
    ).distinct()
    found = P.public_projection(
        catalog(spark, sf_dir).where(F.col("quality") != "quarantined"), now()
    ).where(F.col("evidence.url").isNotNull())
    return asked.join(found, asked.asked_id == found.id).select("asked_id", "temporal_status", "freshness", "withdrawn")


@query("current_vouchers", f"""WITH {STATES_SQL}
SELECT listing_id, CAST(epoch(end_at_exclusive) AS BIGINT) AS end_s,
       CAST(floor((epoch(start_at) + epoch(end_at_exclusive)) / 2) AS BIGINT) <= epoch({NOW_SQL}) AS earning_ended
FROM visible WHERE is_voucher AND temporal_status <> 'future'""")
def current_vouchers(spark, sf_dir):
    """Usable vouchers and whether they can still be earned."""
    return P.current_vouchers(catalog(spark, sf_dir), now()).select(
        F.col("id").alias("listing_id"), F.unix_seconds("validity.end_at_exclusive").alias("end_s"), "earning_ended"
    )


@query("voucher_page", f"""WITH {STATES_SQL}
SELECT listing_id, row_number() OVER (ORDER BY end_at_exclusive NULLS LAST, listing_id) AS rank
FROM visible WHERE is_voucher AND temporal_status <> 'future' QUALIFY rank <= 40""")
def voucher_page(spark, sf_dir):
    """F8: vouchers by end, then id."""
    rows = page(P.current_vouchers(catalog(spark, sf_dir), now()), P.voucher_order(), 40)
    return rows.select(F.col("id").alias("listing_id"), F.col("rank").cast("bigint").alias("rank"))


def manifests(spark, sf_dir):
    """Suppliers as sources: one target each, some switched off, some national."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    joined = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
    return joined.select(
        F.concat(F.lit("src-"), F.col("s_suppkey")).alias("source_id"),
        F.concat(F.lit("ret-"), F.col("s_nationkey")).alias("retailer_id"),
        F.col("n_name").alias("name"),
        F.concat(F.col("s_name"), F.lit(" · "), F.lpad((F.col("s_suppkey") + 41000).cast("string"), 5, "0")).alias("scope_label"),
        F.when(F.col("s_suppkey") % 11 == 0, "national").otherwise("store").alias("scope_type"),
        (F.col("s_acctbal") >= 1000).alias("enabled"),
        F.when(F.col("s_acctbal") >= 5000, "verified_supported").otherwise("partial").alias("audit_status"),
        F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("products"), F.lit("coupons")))
        .otherwise(F.array(F.lit("products"))).alias("capabilities"),
        F.col("s_suppkey").cast("bigint").alias("file_order"),
    )


MANIFESTS_SQL = """manifests AS (
  SELECT 'src-' || s_suppkey AS source_id, 'ret-' || s_nationkey AS retailer_id, n_name AS name,
         s_name || ' · ' || lpad(CAST(s_suppkey + 41000 AS VARCHAR), 5, '0') AS scope_label,
         CASE WHEN s_suppkey % 11 = 0 THEN 'national' ELSE 'store' END AS scope_type,
         s_acctbal >= 1000 AS enabled,
         CASE WHEN s_acctbal >= 5000 THEN 'verified_supported' ELSE 'partial' END AS audit_status,
         s_suppkey % 3 = 0 AS has_coupons, s_suppkey AS file_order
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query("target_search", f"""WITH {MANIFESTS_SQL}
SELECT source_id, CASE WHEN enabled THEN audit_status ELSE 'disabled' END AS support_status FROM manifests
WHERE contains(lower(name || ' ' || scope_label), 'nation_1 supplier#')""")
def target_search(spark, sf_dir):
    """Text search over name and label of targets."""
    return targets.search_targets(manifests(spark, sf_dir), "Nation_1  SUPPLIER#").select("source_id", "support_status")


@query("picker_search", f"""WITH {MANIFESTS_SQL}, marked AS (
  SELECT *, scope_type = 'national' OR contains(lower(name || ' ' || scope_label), '41007') AS hit,
         source_id IN ('src-3', 'src-50', 'src-71') AS chosen FROM manifests WHERE enabled)
SELECT source_id, retailer_id, chosen FROM marked
WHERE (hit OR chosen) AND retailer_id IN (SELECT retailer_id FROM marked WHERE hit)""")
def picker_search(spark, sf_dir):
    """A postal code also matches national targets; what is chosen stays listed."""
    rows = targets.picker_options(manifests(spark, sf_dir), " 41007 ", ["src-3", "src-50", "src-71"])
    return rows.select("source_id", "retailer_id", "chosen")


@query("first_per_retailer", f"""WITH {MANIFESTS_SQL}
SELECT retailer_id, arg_min(source_id, file_order) AS source_id FROM manifests WHERE enabled GROUP BY retailer_id""")
def first_per_retailer(spark, sf_dir):
    """First enabled target of each retailer, in selection order."""
    chosen = manifests(spark, sf_dir)
    return targets.one_target_per_retailer(chosen, F.col("file_order")).select("retailer_id", "source_id")


@query("distinct_targets", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  array_to_string(list_sort(list_distinct(['src-' || l_suppkey, 'src-' || (l_partkey % 7), 'src-' || (l_suppkey % 7)])), ',')
    AS target_ids FROM lineitem""")
def distinct_targets(spark, sf_dir):
    """The distinct targets of a selection, sorted; one selection per line."""
    picked = [F.concat(F.lit("src-"), c) for c in (F.col("l_suppkey"), F.col("l_partkey") % 7, F.col("l_suppkey") % 7)]
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.array_join(targets.distinct_targets(F.array(*picked)), ",").alias("target_ids"),
    )
