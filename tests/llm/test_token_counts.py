"""Token counts against the libraries on whole texts."""

import public_tokenizers
import pytest
from conftest_llm import ODD, make_docs, prose
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from promoforge.llm.token_counts import TokenCounter, count_tokens

JSON, WORDS, MODEL = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ROUGH = ["a<|endoftext|>b <|endoftext|> <|endoftext |>", "x  y   z \n\n w'll don't 12a3 b4.5, é'é", "<|endoftext|>" * 50, "日本語。漢字，文 字", "á b́.", "  lead", "trail  ",
         "tab\tand\r\nlines\n \n  x", "  a b .", "word" * 3000, " " * 4000, "1" * 4000, "!?" * 2000, "é, " * 900, "ﬁ ½ ² ⁵, Ⅷ."]


def whole(path, texts):
    if path.endswith("json"):
        tokenizer = Tokenizer.from_file(path)
        return [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    model = SentencePieceProcessor(model_file=path)
    return [len(model.encode(t or "")) for t in texts]


@pytest.mark.parametrize("path", [JSON, WORDS, MODEL])
@pytest.mark.parametrize("size", [1, 5, 40, 1 << 18])
def test_counts_of_parts_add_up(rng, path, size):
    with open(path, "rb") as file:
        counter = TokenCounter(file.read(), path.rsplit(".")[-1], size)
    alphabet = ["a", "b", "'s", "'", " ", "  ", "\n", "\t", ".", ",", "7", "é", "ß", "日", "。", "<|endoftext|>", "<|", "|>", "endoftext", "!", "́", " ", "😀"]
    texts = ROUGH + [prose(rng, 300).capitalize() + ", " + prose(rng, 40)] + ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(300)]
    assert counter.counts(texts).tolist() == whole(path, texts)
    if path == JSON and size == 40:
        assert len(counter.parts(texts[len(ROUGH)])) > 20
    for text in texts:
        assert "".join(counter.parts(text)) == text


@pytest.mark.parametrize("path", [JSON, MODEL])
def test_token_counts(spark, rng, path):
    rows = ODD + [(100 + i, t) for i, t in enumerate(ROUGH)] + [(300, prose(rng, 30000)), (301, "x" * 1_000_000), (302, " " * 1_000_000), (303, "7," * 300_000)]
    got = count_tokens(make_docs(spark, rows), model=path, batch_bytes=1 << 14).collect()
    want = sorted(((i if i is not None else -1), len((t or "").encode()), n) for (i, t), n in zip(rows, whole(path, [t for _, t in rows]), strict=True))
    assert sorted(((r.id if r.id is not None else -1), r.n_bytes, r.n_tokens) for r in got) == want
    assert count_tokens(make_docs(spark, [])).collect() == []


def test_unknown_files_are_refused(spark):
    with pytest.raises(ValueError):
        count_tokens(make_docs(spark, []), model=public_tokenizers.path("byte_bpe_50k.tiktoken"))
