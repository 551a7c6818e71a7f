"""Near words and roots against plain comparison of all words."""

import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ODD, make_docs

from promoforge.llm import spelling_variants as sv


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(counts, min_length=sv.MIN_LENGTH, min_count=sv.MIN_COUNT, ratio=sv.RATIO):
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, n, len(near[w]), form[w] or "", words.get(form[w]) or 0, root(w)) for w, n in words.items())


def found(spark, counts, **options):
    rows = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, key string")
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in sv.group_variants(rows, **options).collect())


def vocabulary(rng, words=150):
    counts = Counter()
    for _ in range(words):
        word = "".join(rng.choice("abcéÿßz") for _ in range(rng.randrange(5, 9)))
        counts[word] += rng.choice((3, 5, 5, 50, 700))
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(word) + 1)
            word = rng.choice((word[:i] + word[i + 1:], word[:i] + rng.choice("abÀz") + word[i:], word[:i] + rng.choice("abÿ") + word[i + 1:]))
            counts[word] += rng.choice((5, 6, 40))
    counts |= {"aaaaaa": 9, "aaaaaaa": 99, "aaaaaaaa": 9999, "b" * 63: 5, "b" * 64: 50, "b" * 65: 500, "b" * 66: 5, "c" * 5000: 6, "c" * 4999 + "d": 70, "c" * 4999: 7,
               "ties12": 5, "tiesaa": 30, "tiesab": 30}
    return counts


@pytest.mark.parametrize("options", [{}, {"most": 1 << 14}, {"bits": 64}, {"min_length": 2, "min_count": 1, "ratio": 2}])
def test_against_plain_comparison(spark, rng, options):
    counts = vocabulary(rng)
    own = {k: v for k, v in options.items() if k not in {"bits", "most"}}
    want = plain(counts, **own)
    assert found(spark, counts, **options) == want
    assert any(w[3] for w in want) and any(w[3] and w[3] != w[5] for w in want)


def test_probes_meet_every_edit(rng):
    words = list(vocabulary(rng))
    by_length = {k: [words[i] for i in rows] for k, rows in sv._by_length(words).items()}
    keys = {w: int(k) for group in by_length.values() for w, k in zip(group, sv.word_keys(sv._letters(group)), strict=True)}
    assert len(set(keys.values())) == len(keys)
    counts = Counter(min(len(w), sv.LONGEST) for w in words)
    places = sv.Filters.layout(counts)
    blocks = np.zeros(sum(n for _, n in places.values()), np.uint64)
    for w, k in keys.items():
        k = np.array([k], np.uint64)
        blocks[sv.Filters.block_of(k, places[min(len(w), sv.LONGEST)])] |= sv._masks(k)
    alphabet = np.array(sorted({ord(c) for w in words for c in w}), np.uint64)
    met, probes = set(), 0
    for group in by_length.values():
        a, b = sv.probe(group, sv.Filters(blocks, places), alphabet)
        met |= set(zip(a.tolist(), b.tolist(), strict=True))
        for word in group[:20]:
            one, wide = (sorted(zip(*(x.tolist() for x in pair), strict=True)) for pair in (
                sv.probe([word], sv.Filters(blocks, places), alphabet), sv.probe_wide(word, sv.Filters(blocks, places), alphabet)))
            assert one == wide
        probes += len(group) * len(group[0]) * (len(alphabet) + 1)
    for a in words:
        for b in words:
            if a != b and one_edit(a, b) and (len(b) < len(a) or len(a) == len(b) and a < b):
                assert (keys[a], keys[b]) in met
    assert len(met) < probes / 20


def test_words_of_texts(spark):
    rows = [*ODD, (7, "Straße STRASSE naïve ÀBŸ x×y don't a1b"), (7, "straße")]
    want = Counter(w for _, t in rows for w in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    assert {r.word: r.n for r in sv.count_words(make_docs(spark, rows)).collect()} == want
    assert sv.count_words(make_docs(spark, [])).collect() == []
    assert found(spark, {}) == []
