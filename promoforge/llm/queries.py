"""The registered queries of the text operators: thin bindings to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promoforge.llm import quality_sql
from promoforge.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


@query("op10_quality_outliers", quality_sql.statement())
def op10_quality_outliers(spark, sf_dir):
    from promoforge.llm.quality_outliers import judge_quality

    return judge_quality(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS said FROM (
    SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), spoken AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS said FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT s.doc_id, s.i, s.n, w.item_id FROM spoken s JOIN windows w USING (said, n)
), words AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op9_winnowing", OP9_SQL)
def op9_winnowing(spark, sf_dir):
    from promoforge.llm.winnowing import find_benchmark

    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op2_simhash_planes")
def op2_simhash_planes(spark, sf_dir):
    from promoforge.llm.simhash_planes import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("op4_line_patience")
def op4_line_patience(spark, sf_dir):
    from promoforge.llm.line_patience import dedup_lines

    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "text", "n_lines", "n_removed", "copy")


OP3_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 99))) AS i FROM d)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM strings) WHERE n > 1
), numbered AS (
  SELECT doc_id, i, sum(CASE WHEN i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i) AS before FROM repeated)
), runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, run
), pieces AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_byte FROM runs
), rest AS (
  SELECT p.doc_id, sum(p.b - p.a) AS n_removed, count(*) AS n_spans, max(p.b) AS last, string_agg(substr(d.h, 2 * p.from_byte + 1, 2 * (p.a - p.from_byte)), '' ORDER BY p.a) AS kept
  FROM pieces p JOIN d USING (doc_id) GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(d.h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN rest USING (doc_id)
"""


@query("op3_suffix_induction", OP3_SQL)
def op3_suffix_induction(spark, sf_dir):
    from promoforge.llm.suffix_induction import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query("op5_unigram_pieces")
def op5_unigram_pieces(spark, sf_dir):
    from promoforge.llm.unigram_pieces import encode_texts

    return encode_texts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op1_toxicity_lexicon")
def op1_toxicity_lexicon(spark, sf_dir):
    from promoforge.llm.toxicity_lexicon import THRESHOLD, learn_toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = learn_toxicity(docs, labels, ~held_out)
    return model.score(docs).select(F.col("id").alias("doc_id"), F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
                                    "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("hits").alias("n_hits"))


@query("op7_pii_anchors")
def op7_pii_anchors(spark, sf_dir):
    from promoforge.llm.pii_anchors import BASE_KINDS, personal_data

    def said(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return personal_data(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), *[of_kind(k) for k in BASE_KINDS], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


@query("op8_html_crf")
def op8_html_crf(spark, sf_dir):
    from promoforge.llm.common import code_points
    from promoforge.llm.html_crf import extract_main

    return extract_main(table(spark, sf_dir, "pages"), keep=("url",)).select(F.col("id").alias("page_id"), "url", "text", code_points(F.col("text")).alias("n_chars"))


# Verdict, host and path of the rules of op6.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _dotless_sql(path: str) -> str:
    """A path without its dot segments: the segments folded to a list."""
    segments = f"list_transform(string_split({path}, '/')[2:], lambda s, i: CASE WHEN s IN ('.', '..') AND i = len(string_split({path}, '/')) - 1 THEN [s, ''] ELSE [s] END)"
    steps = f"list_transform(flatten({segments}), lambda s: [s])"
    folded = f"list_reduce(list_prepend(CAST([] AS VARCHAR[]), {steps}), lambda kept, s: CASE s[1] WHEN '.' THEN kept WHEN '..' THEN kept[:len(kept) - 1] ELSE list_concat(kept, s) END)"
    return f"CASE WHEN regexp_matches({path}, '/\\.\\.?(/|$)') THEN '/' || array_to_string({folded}, '/') ELSE {path} END"


def _resolved_sql(base: str, ref: str) -> str:
    """A reference seen from a base url."""
    whole = rf"""CASE WHEN regexp_matches({ref}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {ref}
      WHEN {ref} LIKE '//%' THEN regexp_extract({base}, '^[^:]+:') || {ref}
      WHEN {ref} LIKE '/%' THEN regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') || {ref}
      WHEN {ref} LIKE '#%' THEN regexp_replace({base}, '#.*$', '') || {ref}
      WHEN {ref} LIKE '?%' THEN regexp_replace({base}, '[?#].*$', '') || {ref}
      WHEN regexp_matches({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/') THEN regexp_replace(regexp_replace({base}, '[?#].*$', ''), '/[^/]*$', '/') || {ref}
      ELSE regexp_replace({base}, '[?#].*$', '') || '/' || {ref} END"""
    return f"({whole})"


_PATH = "regexp_extract(rest, '^[^/?#]*([^?#]*)', 1)"
OP6_SQL = r"""
WITH RECURSIVE rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), tags AS (
  SELECT url AS src, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>', ' ', 'g'),
                                               '(?i)<(?:link|meta|base)(?:[\s/](?:[^<>"'']|"[^"]*"|''[^'']*'')*)?>')) AS tag, generate_subscripts(tag_list, 1) AS place
  FROM (SELECT url, html, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>', ' ', 'g'),
                                               '(?i)<(?:link|meta|base)(?:[\s/](?:[^<>"'']|"[^"]*"|''[^'']*'')*)?>') AS tag_list FROM pages WHERE url IS NOT NULL AND html IS NOT NULL)
), attributes AS (
  SELECT src, place, lower(regexp_extract(tag, '^<([A-Za-z]+)', 1)) AS kind, lower(a.name) AS name, trim(replace(trim(a.value, '"'''), '&amp;', '&'), E' \t\n\r') AS value FROM (
    SELECT src, place, tag, unnest(list_transform(regexp_extract_all(tag, '[\s/]+([^\s=>/]+)(?:\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+))?', 1), lambda n, i: {'name': n, 'at': i,
        'value': regexp_extract_all(tag, '[\s/]+([^\s=>/]+)(?:\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+))?', 2)[i]})) AS a FROM tags)
), stated AS (
  SELECT src, place, kind, max(value) FILTER (name = 'rel') AS rel, max(value) FILTER (name = 'href') AS href, max(value) FILTER (name = 'http-equiv') AS equiv,
         max(value) FILTER (name = 'content') AS content FROM attributes GROUP BY ALL
), bases AS (
  SELECT src, first(href ORDER BY place) AS ref FROM stated WHERE kind = 'base' AND href <> '' GROUP BY src
), refs AS (
  SELECT src, CASE WHEN list_contains(regexp_split_to_array(lower(rel), '\s+'), 'canonical') THEN href
                   WHEN lower(equiv) = 'refresh' THEN regexp_extract(content, '(?is)^[\s\d.]*[;,]?\s*(?:url\s*=\s*)?["'']?\s*(.*?)\s*["'']?$', 1) END AS ref
  FROM stated WHERE kind <> 'base'
), asked AS (
  SELECT 'base' AS what, src, src AS base, ref FROM bases
  UNION ALL SELECT 'link', r.src, coalesce({resolved_base}, r.src), r.ref FROM refs r LEFT JOIN bases b ON b.src = r.src WHERE r.ref <> ''
), links AS (
  SELECT DISTINCT src, {resolved_link} AS dst FROM asked WHERE what = 'link'
), urls AS (
  SELECT url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         {dotless} AS dotless,
         array_to_string(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]*|ref|fbclid|gclid)=')), '&') AS query
  FROM (SELECT url, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
        FROM (SELECT url FROM pages UNION SELECT src FROM links UNION SELECT dst FROM links WHERE contains(dst, '://')))
), keyed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(dotless, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS key FROM urls
), ruled AS (
  SELECT url, arg_max(rule, size) AS rule, arg_max(verdict, size) AS verdict FROM (
    SELECT k.url, r.host || r.path AS rule, length(r.host || r.path) AS size, r.verdict
    FROM keyed k JOIN rules r ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path)) GROUP BY url
), edges AS (
  SELECT a.key AS x, b.key AS y FROM links l JOIN keyed a ON a.url = l.src JOIN keyed b ON b.url = l.dst WHERE a.key <> b.key
), both_ways AS (
  SELECT x, y FROM edges UNION SELECT y, x FROM edges
), reach(x, y) AS (
  SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x
), placed AS (
  SELECT url, least(key, coalesce((SELECT min(y) FROM reach WHERE x = key), key)) AS component FROM keyed WHERE key IS NOT NULL
), spread AS (
  SELECT component, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS carried FROM placed JOIN ruled USING (url) GROUP BY component
)
SELECT p.page_id, k.host, k.path, r.rule, coalesce(r.verdict, s.carried, 'allow') AS verdict
FROM pages p JOIN keyed k ON k.url IS NOT DISTINCT FROM p.url LEFT JOIN placed c ON c.url = p.url LEFT JOIN ruled r ON r.url = p.url LEFT JOIN spread s ON s.component = c.component
""".replace("{resolved_base}", _resolved_sql("b.src", "b.ref")).replace("{resolved_link}", _resolved_sql("base", "ref")).replace("{dotless}", _dotless_sql(_PATH))


@query("op6_redirects", OP6_SQL)
def op6_redirects(spark, sf_dir):
    from promoforge.llm.redirects import judge_urls, rules_table

    return judge_urls(table(spark, sf_dir, "pages"), rules_table(spark, URL_RULES)).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


# Tokens of a training context; longer texts are marked.
CONTEXT_TOKENS = 1024


@query("op11_token_counts")
def op11_token_counts(spark, sf_dir):
    from promoforge.llm.token_counts import count_tokens

    counted = count_tokens(table(spark, sf_dir, "documents"))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > CONTEXT_TOKENS).alias("over_limit"))


OP13_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query("op13_residue_negatives", OP13_SQL)
def op13_residue_negatives(spark, sf_dir):
    from promoforge.llm.hard_negatives import mine_negatives

    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_negatives(rows, F.col("vec_id") % 50 == 0).select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank",
                                                                  F.col("negative").alias("negative_id"), "positive_score", "negative_score")


# Letters beyond a-z are mapped to single bytes for the byte-wise distance; crc32 is stated on bytes with its table.
OP12_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(list_prepend(CAST(b AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t
  FROM range(256) r(b)
), runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL
), bytes AS (
  SELECT run, times, hex(encode(doc_id || ':' || run)) AS h FROM runs
), hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(h), 2), lambda i:
      CAST((strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1 AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS h
  FROM bytes, tab
), said AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, times FROM hashed
), words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n, translate(word, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_{|}~') AS plain
  FROM said GROUP BY word HAVING length(word) >= 6 AND sum(times) >= 5
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM words a JOIN words b ON abs(length(a.word) - length(b.word)) <= 1 AND a.word <> b.word AND levenshtein(a.plain, b.plain) = 1
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
), named AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)
), chain(word, last) AS (
  SELECT word, word FROM named UNION ALL SELECT c.word, n.form FROM chain c JOIN named n ON n.word = c.last WHERE n.form IS NOT NULL
), ends AS (
  SELECT c.word, c.last AS root FROM chain c JOIN named n ON n.word = c.last WHERE n.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM named JOIN ends USING (word)
"""


@query("op12_bloom_variants", OP12_SQL)
def op12_bloom_variants(spark, sf_dir):
    from promoforge.llm.spelling_variants import count_words, group_variants

    def misspelt(doc_id, run):
        """One of 199 runs loses a letter."""
        h = F.crc32(F.concat(doc_id, F.lit(":"), run))
        at = (h % F.char_length(run)).cast("int")
        return F.when(h % 199 == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)

    return group_variants(count_words(table(spark, sf_dir, "documents"), alter=misspelt)).select("word", "form", "root", "n", "n_near", "form_n")
