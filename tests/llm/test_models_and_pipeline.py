"""Tokens, toxicity, pages, urls and the pipeline: exact round trips, held-out accuracy, SQL and brute force."""

import html
import itertools
import math
import re
import time
import tracemalloc
from pathlib import Path

import duckdb
import numpy as np
import pytest
import sentencepiece
from conftest_llm import ODD, make_docs, prose
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

import promoforge.llm.queries as queries
from promoforge.llm.html_crf import RAW_TAGS, Chain, as_training, chances, default_chain, extract_main, labelled_pages, leaf_blocks, main_text
from promoforge.llm.redirects import judge_urls, rules_table
from promoforge.llm.toxicity_lexicon import Lexicon, ToxicityModel, choose_terms, fold, learn_toxicity
from promoforge.llm.unigram_pieces import MARK, MODEL, DoubleArray, Encoder, Vocabulary, decode_pieces, encode_texts

SF = Path("/root/testdata/sf0.01")
needs_tables = pytest.mark.skipif(not SF.exists(), reason="tables not available")
needs_model = pytest.mark.skipif(not Path(MODEL).exists(), reason="vocabulary file not available")


# --- pieces -------------------------------------------------------------------------------------

def test_double_array():
    entries = {bytes([a, b, c][:n]): 100 * a + 10 * b + c + n for a in range(0, 250, 50) for b in (0, 255, 7) for c in (1, 2) for n in (1, 2, 3)}
    trie = DoubleArray(entries)

    def find(key):
        state = 0
        for c in key:
            nxt = trie.base[state] + c + 1
            if nxt >= len(trie.check) or trie.check[nxt] != state:
                return -1
            state = nxt
        return trie.value[state]

    assert {k: find(k) for k in entries} == entries
    assert find(b"\x01") == find(b"\x00\x00\x01\x00") == -1


@needs_model
def test_pieces_equal_the_library(rng):
    vocabulary = Vocabulary.load(MODEL)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(Path(MODEL).read_bytes())
    proto.trainer_spec.model_type = 1
    for piece, score in zip(proto.pieces, vocabulary.scores, strict=True):
        piece.score = score
    library, encoder = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()), Encoder(vocabulary)
    texts = ["", " ", "a", "  a  b ", "Hello wörld, 12345!\n\ttab", "日本語 🎉 \x00", "x" * 300, MARK + "marked " + MARK] + [
        "".join(rng.choice("abc de  fgéß.,!$\n日🎉") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    for text in texts:
        mine = encoder.encode(text).tolist()
        theirs = library.encode(text)
        if mine != theirs:  # equal scores may be cut differently
            def total(ids):
                return sum(vocabulary.scores[i] if i not in vocabulary.byte_ids.values() else 0 for i in ids)
            assert abs(total(mine) - total(theirs)) < 1e-3 and len(mine) == len(theirs), text
        assert encoder.decode(mine) == text.replace(MARK, " ")


@needs_model
def test_encoding_of_tables(spark):
    docs = make_docs(spark, ODD)
    got = encode_texts(docs)
    assert got.count() == len(ODD) and got.where("not exact").count() == 0
    assert {tuple(r.ids) for r in got.where("id in (1, 2)").collect()} == {()}
    back = decode_pieces(got.where("id in (3, 8)")).collect()
    assert {r.id: r.text for r in back} == {3: " \t\n\x0b ", 8: "a,b;c"}
    assert encode_texts(docs.limit(0)).count() == 0


# --- toxicity -------------------------------------------------------------------------------------

def test_folding():
    assert fold("You Id10t, іdiot ｉｄｉｏｔ 1diot $cum 1005 a1 idiot!! c@t i\u200bdiot") == "you idiot, idiot idiot idiot scum 1005 a1 idiot!! cat i​diot".replace("i\u200bdiot", "idiot")


def test_folding_of_very_long_texts():
    for text in ("x" * 1_000_000, "x1" * 500_000, "1" * 1_000_000, "$" * 1_000_000, "x" + "1" * 1_000_000, " 1" * 500_000, "ｘ" * 1_000_000):
        start = time.process_time()
        assert len(fold(text)) == len(text)
        assert time.process_time() - start < 10
    assert fold("𝕚𝕕𝕚𝕠𝕥 ⓘⓓⓘⓞⓣ ıdɪօt") == "idiot idiot idiot"
    lexicon = Lexicon({"fiend": 1.0}, ["friendly fiend"])
    start = time.process_time()
    assert len(lexicon.hits("friendly fiend and fiend " * 40_000)) == 40_000
    assert time.process_time() - start < 10


def test_terms_beyond_the_bound_are_counted():
    counts = {f"word{i:03}x": (50 + i, 0) for i in range(20)}
    chosen, cut = choose_terms(counts, 100, 1000, most=5)
    assert len(chosen) == 5 and cut == 15 and "word019x" in chosen


def test_terms_are_words_or_beginnings():
    counts = {"idiot": (50, 0), "idio*": (50, 0), "idiot*": (50, 0), "vequ*": (60, 1), "vequa": (9, 0), "vequt": (8, 0), "vequa*": (20, 0), "house": (60, 500), "rare": (2, 0)}
    assert set(choose_terms(counts, 120, 1000)[0]) == {"idiot", "vequ*"}


def test_learning_and_scores(spark, rng):
    rows, labels = list(ODD), []
    for i in range(400):
        toxic = i % 5 == 0
        words = prose(rng, rng.randint(5, 80)).split()
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(("mogul", "dastard", "fiend")))
        elif i % 7 == 0:
            words.insert(rng.randrange(len(words)), "friendly fiend")
        rows.append((100 + i, " ".join(words)))
        labels.append((100 + i, int(toxic), "x"))
    labels += [(None, 1, "x"), (1, 1, "x"), (101, None, "x"), (100, 1, "x")]
    docs, marks = make_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    model = learn_toxicity(docs, marks, F.col("doc_id") % 3 != 1)
    assert {"mogul", "dastard"} <= set(model.weights)
    got = {r.id: r.score for r in model.score(docs).collect()}
    right = sum((got[100 + i] >= 0.7) == (i % 5 == 0) for i in range(400) if (100 + i) % 3 == 1)
    assert right >= 0.9 * sum((100 + i) % 3 == 1 for i in range(400))
    assert got[2] < 0.5 and got[1] == got[2] and len(model.score(docs).collect()) == len(rows)
    assert model.score(docs.limit(0)).count() == 0
    none = learn_toxicity(docs, marks.limit(0), F.lit(True))
    assert {r.score for r in none.score(docs).collect()} == {0.0}


def test_exceptions(spark):
    model = ToxicityModel({"fiend": 5.0}, ["friendly fiend"], [-3.0, 6.0, 1.0])
    got = {r.id: len(r.hits) for r in model.score(make_docs(spark, [(1, "a friendly fiend"), (2, "a fiend"), (3, "fiends"), (4, "friendly fiend, F1end")])).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1}


@needs_tables
def test_held_out_accuracy(spark):
    got = queries.QUERIES["op1_toxicity_lexicon"](spark, str(SF))
    rows = got.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert got.count() == 1000
    assert sum(r.predicted == r.toxic for r in rows) >= 0.95 * len(rows)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.02 * len(rows)


# --- pages ----------------------------------------------------------------------------------------

def test_blocks_of_broken_markup():
    assert [b.text for b in leaf_blocks("<p>a<p>b <b>c</b>d<br>e &amp; &lt;x&gt; 1 < 2</div><li>f<script>x='</p>'</script><!-- g --><td>h")] == ["a", "b cd e & <x> 1 < 2", "f", "h"]
    assert [b.text for b in leaf_blocks("<div>" * 5000 + "deep" + "<p>" * 3000 + "end")] == ["deep", "end"]
    assert leaf_blocks("") == [] and [b.text for b in leaf_blocks("plain")] == ["plain"] and [b.text for b in leaf_blocks("<")] == ["<"]


@pytest.mark.parametrize("tag", sorted(RAW_TAGS))
def test_raw_elements_lose_no_text(tag):
    def said(page):
        return [b.text for b in leaf_blocks(page)]

    assert said(f"<p>a<{tag} class=i>x<p>y</{tag}>b<p>c") == ["ab", "c"]
    assert said(f"<p>a<{tag} class=i/>b<p>c") == said(f"<p>a<{tag} class='i' />b<p>c") == ["ab", "c"]
    assert said(f"<p>a<{tag}>b<p>c") == (["a"] if tag in ("script", "style") else ["ab", "c"])
    assert said(f"<p>a<{tag}>x</{tag} >b<{tag.upper()}>y</{tag.upper()}>c") == ["abc"]


def test_deep_markup_takes_linear_room():
    deep, chain = 50_000, default_chain()
    for page in ("".join(f"<div class=k{i % 7}>t{i}" for i in range(deep)), "<b>" * deep + "t<hr>" * deep, "<b>" * deep + "t</i>" * deep, "<svg>" * deep + "t",
                 "<i><p>t" * deep, "<td><b>t" * deep):
        start = time.process_time()
        whole = main_text(page, chain)
        assert time.process_time() - start < 15
        tracemalloc.start()
        assert main_text(page, chain) == whole and tracemalloc.get_traced_memory()[1] < 300e6
        tracemalloc.stop()


def test_viterbi_and_gradient_against_enumeration(rng):
    names = ["a", "b", "c", "d"]
    for n in range(1, 8):
        weights = {f: (rng.gauss(0, 1), rng.gauss(0, 1)) for f in names}
        chain = Chain(weights, [[rng.gauss(0, 1), rng.gauss(0, 1)], [rng.gauss(0, 1), rng.gauss(0, 1)]])
        rows = [rng.sample(names, rng.randint(1, 4)) for _ in range(n)]

        def total(labels, rows=rows, chain=chain):
            return (sum(chain.weights[f][y] for row, y in zip(rows, labels, strict=True) for f in row)
                    + sum(chain.transitions[x][y] for x, y in zip(labels, labels[1:], strict=False)))

        ways = list(itertools.product((0, 1), repeat=n))
        assert total(chain.decode(rows)) == pytest.approx(max(map(total, ways)))
        # Chances of label 1 and of neighbouring labels from all ways.
        weight = [math.exp(total(w)) for w in ways]
        ones, pairs = chances(np.array([[sum(chain.weights[f][y] for f in row) for y in (0, 1)] for row in rows]), np.array(chain.transitions))
        for i in range(n):
            assert ones[i, 1] == pytest.approx(sum(x for x, w in zip(weight, ways, strict=True) if w[i]) / sum(weight))
        for x, y in itertools.product((0, 1), repeat=2):
            want = sum(v * sum((a, b) == (x, y) for a, b in zip(w, w[1:], strict=False)) for v, w in zip(weight, ways, strict=True)) / sum(weight)
            assert pairs[x, y] == pytest.approx(want)


def test_chain_on_unseen_pages():
    chain, right, total = default_chain(), 0, 0
    for page, main in labelled_pages(150, seed=5):
        rows, labels = as_training(page, main)
        assert sum(labels) == len(main)
        right += sum(a == b for a, b in zip(chain.decode(rows), labels, strict=True))
        total += len(labels)
    assert right >= 0.98 * total


def test_pages_of_any_kind(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "<article><p>Some words here.</p></article>", "x"), (3, "<article><p>Twice.</p></article>", "x"), (3, "<article><p>Twice.</p></article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted((r.id or 0, r.text) for r in extract_main(pages).collect())
    assert got == [(0, "Some words here."), (1, ""), (2, ""), (3, "Twice."), (3, "Twice.")]
    assert extract_main(pages.limit(0)).count() == 0


@needs_tables
def test_given_pages():
    chain = default_chain()
    for (page,) in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert main_text(page, chain) == "\n".join(b for b in blocks if b)


# --- urls -----------------------------------------------------------------------------------------

PAGES = [
    (1, "http://a.example.org/es/1", None), (2, "https://www.b.net/x/?utm_source=f#top", ""), (3, "http://b.net/x", "<link rel=canonical href='http://a.example.org/es/1'>"),
    (4, "https://c.net/y", '<meta http-equiv="refresh" content="0; url=/z">'), (5, "https://m.c.net/z/", '<LINK HREF="//d.com/fr/9" REL="canonical">'),
    (6, "no url", "x"), (7, None, None), (8, "ftp://EXAMPLE.org/en/12?q#f", "<p>"), (8, "ftp://EXAMPLE.org/en/12?q#f", "<p>"), (None, "http://notexample.org.de/", None),
    (9, "http://f.de/1", "<link rel='canonical' href='http://b.net/x?ref=1'><meta http-equiv=refresh content='1;URL=https://g.de/'>"), (10, "https://g.de", None), (11, "x://com/de/a", None),
    # Relative, dotted and quoted references, a base, other attributes, and links that are none.
    (20, "http://h.net/a/b", "<link rel='canonical' href='../c/./d'>"), (21, "http://h.net/c/d/", '<link data-x=1 title="rel=x href=y" href="../../a/../e" rel="alternate canonical"/>'),
    (22, "http://h.net/e", "<link rel=canonical href=http://example.org/es/k>"), (23, "http://h.net/c/e", None), (24, "http://h.net/q/../w/.", None),
    (25, "http://i.net/w/", "<!-- <link rel=canonical href=http://example.org/es/9> --><script>'<link rel=canonical href=\\'http://example.org/es/9\\'>'</script>"),
    (26, "http://j.net/", "<link rel=stylesheet href=http://example.org/es/9><a rel=canonical href=http://example.org/es/9><meta name=refresh content='0;url=http://example.org/es/9'>"),
    (27, "http://k.net/x/y?z#f", "<base target=_top><base href='/v/'><link rel=canonical href='?page=2&amp;a=b'>"), (28, "http://k.net/v/?page=2&a=b", '<meta http-equiv="Refresh" content="5, http://example.org/es/">'),
    (29, "http://l.net/a", "<meta http-equiv=refresh content='3'><meta content='0; URL=\"b\"' http-equiv=REFRESH>"), (30, "http://l.net/b", "<link rel=canonical href=mailto:x@y.de>"),
    (31, "http://m.net", "<link rel=canonical href=n>"), (32, "http://m.net/n", "<link href='//example.org/es/z' rel=CANONICAL>"), (33, "http://o.net/#x", "<link rel=canonical href=#y><link rel=canonical href=''>")]


def test_urls_equal_their_sql(spark):
    frame = spark.createDataFrame([(*p, "x", "x") for p in PAGES], "page_id long, url string, html string, key string, host string")
    got = sorted(repr((r.id, r.host, r.path, r.rule, r.verdict)) for r in judge_urls(frame, rules_table(spark, queries.URL_RULES)).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    want = sorted(repr((r[0], *r[1:])) for r in con.execute("SELECT page_id, host, path, rule, verdict FROM (" + queries.OP6_SQL + ")").fetchall())
    assert got == want
    verdict = {r.id: r.verdict for r in judge_urls(frame, rules_table(spark, queries.URL_RULES)).collect()}
    assert [verdict[i] for i in (1, 2, 3, 4, 5, 9, 10)] == ["block", "block", "block", "allow", "allow", "block", "block"]
    assert [i for i in range(20, 34) if verdict[i] == "block"] == [20, 21, 22, 27, 28, 31, 32]
    assert judge_urls(frame.limit(0), rules_table(spark, queries.URL_RULES)).count() == 0


def test_given_redirects(spark):
    frame = spark.createDataFrame([(1, "http://p.net/", None), (2, "http://q.net/", None)], "page_id long, url string, html string")
    edges = spark.createDataFrame([("http://p.net/", "http://r.example.org/es/"), ("http://q.net/", "http://p.net"), (None, "x")], "src string, dst string")
    assert {r.verdict for r in judge_urls(frame, rules_table(spark, queries.URL_RULES), edges).collect()} == {"block"}


# --- registered queries and the pipeline ------------------------------------------------------------

@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, str(SF))
    cursor = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, cursor.fetchall()))


@needs_tables
@needs_model
def test_pipeline(spark):
    import corpus_pipeline
    from promoforge.session import written_once

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = written_once(stage(spark, docs, str(SF)), name)
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(after) == len(set(after)) and set(after) <= before and len(after) > 0.7 * len(before), name
        if name != "pieces":
            assert docs.columns == columns
    assert docs.where("not exact").count() == 0


@needs_model
def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "w " * 30)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (ODD, []):
        docs = make_docs(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.count() <= len(rows)
