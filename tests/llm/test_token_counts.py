import pytest
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")

from pathsieve.llm import token_counts  # noqa: E402
from pathsieve.llm.token_counts import TokenCounter, count_tokens  # noqa: E402


def test_counts_are_the_library_s(spark):
    texts = ["the cat's end  \n\n x", "", None, "a<|endoftext|> b<|endoftext|>", "ü\x85\x1c 漢字🙂" * 50, "the " * 5000, "=" * 9000, "the cat's end  \n\n x"]
    df = spark.createDataFrame([(i % 7, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i % 7, len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts))
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in count_tokens(df).collect()) == want
    assert count_tokens(df.limit(0)).count() == 0


def test_other_tokenizers(spark):
    df = spark.createDataFrame([(1, "Hello there, you"), (2, None)], "doc_id long, text string")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.doc_id: r.n_tokens for r in count_tokens(df, tokenizer="piece_bpe_32k.model").collect()} == {1: len(model.encode("Hello there, you")), 2: 0}
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id: r.n_tokens for r in count_tokens(df, tokenizer="word_bpe_49k.json").collect()}[1] == len(own.encode("Hello there, you", add_special_tokens=False).ids)


def test_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_BYTES", 3000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = TokenCounter(path), Tokenizer.from_file(path)
    for text in [f"word{i} {'z' * 300}{i} {i}" for i in range(60)] * 2:
        assert own.count([text]) == [len(library.encode(text, add_special_tokens=False).ids)]
        assert own.cached <= 4500 and not any(len(w) > token_counts.KEPT_CHARS for w in own.cache)
        assert own.cached == sum(token_counts.ENTRY_BYTES + len(w) for w in own.cache)
