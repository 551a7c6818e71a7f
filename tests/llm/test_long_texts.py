"""Every operator and stage on texts of a million characters without what usually divides them."""

import time

import pytest
from conftest_llm import make_docs

import corpus_pipeline
from promoforge.llm.hard_negatives import mine_negatives  # noqa: F401  (imports without its table)
from promoforge.llm.html_crf import extract_main
from promoforge.llm.line_patience import dedup_lines
from promoforge.llm.pii_anchors import personal_data
from promoforge.llm.quality_outliers import judge_quality
from promoforge.llm.redirects import judge_urls, rules_table
from promoforge.llm.simhash_planes import near_duplicates
from promoforge.llm.spelling_variants import count_words, group_variants
from promoforge.llm.suffix_induction import remove_repeats
from promoforge.llm.token_counts import count_tokens
from promoforge.llm.toxicity_lexicon import ToxicityModel
from promoforge.llm.unigram_pieces import encode_texts
from promoforge.llm.winnowing import find_benchmark

SIZE = 1_000_000
LONG = {"letters": "x" * SIZE, "separators": "a" + " " * SIZE + "b", "digits": "7" * SIZE, "signs": "#" * SIZE, "line": "some words of a line " * (SIZE // 21), "marks": "@" * SIZE,
        "lines": "\n" * SIZE, "dots": "a." * (SIZE // 2), "quotes": "<a \"" * (SIZE // 4)}
OPERATORS = {
    "toxicity": lambda d, e: ToxicityModel({"fiend": 1.0}, ["a fiend"], [0.0, 1.0, 1.0]).score(d), "simhash": lambda d, e: near_duplicates(d), "suffixes": lambda d, e: remove_repeats(d),
    "lines": lambda d, e: dedup_lines(d), "pieces": lambda d, e: encode_texts(d), "pii": lambda d, e: personal_data(d), "html": lambda d, e: extract_main(d, "doc_id", "text"),
    "urls": lambda d, e: judge_urls(d, rules_table(d.sparkSession, [("block", "a.b", "/")]), None, "doc_id", "source", "text"), "winnowing": lambda d, e: find_benchmark(d, e),
    "quality": lambda d, e: judge_quality(d), "tokens": lambda d, e: count_tokens(d), "variants": lambda d, e: group_variants(count_words(d), min_count=1)}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("long")
    make_docs(spark, [(i, t, "en", "http://s.net/") for i, t in enumerate(LONG.values())]).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "w " * 30), (2, LONG["letters"])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(tables, name):
    _, docs, items = tables
    start = time.time()
    rows = OPERATORS[name](docs, items).collect()
    assert len(rows) == len(LONG) or name == "variants"
    assert time.time() - start < 60, f"{time.time() - start:.0f} s"


def test_stages(spark, tables):
    folder, docs, _ = tables
    start = time.time()
    for _, stage in corpus_pipeline.STAGES:
        # Each stage takes all texts, whatever the one before thinks of them.
        assert stage(spark, docs, folder).count() <= len(LONG)
    assert time.time() - start < 120, f"{time.time() - start:.0f} s"
