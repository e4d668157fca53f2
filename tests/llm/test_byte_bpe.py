import base64
import hashlib
import random

import pytest
import tiktoken

public_tokenizers = pytest.importorskip("public_tokenizers")

from pathsieve.llm import byte_bpe  # noqa: E402
from pathsieve.llm.byte_bpe import ByteBpe, decode, digests, encode  # noqa: E402

NAME = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(NAME), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_encode_as_the_library_does(library):
    own, pick = ByteBpe(public_tokenizers.path(NAME)), random.Random(5)
    alphabet = ["a", "the", "'s", "'re", "'v", "'", "''ll", " ", "  ", "\n", "\t ", " ", "　", "é", "ß", "9", "12", "٣", "½", ".", "###", "漢字", "🙂", "́", "\x1c", "\x85", "I'm", "'D", "<|endoftext|>"]
    texts = ["".join(pick.choices(alphabet, k=pick.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "  ", "'", "'s", " 's", "a" * 5000, "ab" * 3000, "=" * 3001, " " * 300 + "x", "x" + " " * 300]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode_ordinary(text)
        assert ids == b"".join(i.to_bytes(4, "little") for i in want), text
        assert own.decode(ids) == text.encode()


def test_long_words_merge_by_a_heap(monkeypatch, library):
    own, pick = ByteBpe(public_tokenizers.path(NAME)), random.Random(8)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "aab", "etaoin", "漢字仮名交文", "=-", "éßüa"]
    texts = ["".join(pick.choices(k, k=pick.choice([200, 255, 256, 257, 300, 2000, 9000]))) + " and so on" for k in kinds for _ in range(6)]
    texts += ["the" * 40_000, "".join(pick.choices("漢字仮名交文的一是不", k=100_000))]
    want = [b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(t)) for t in texts]
    assert own.encode(texts) == want
    assert [own.decode(x) for x in want] == [t.encode() for t in texts]
    # each way alone
    words = [t.split(" ")[0].encode() for t in texts[:36]]
    assert [own.merger._merge_long(w) for w in words] == own.merger._merge_together(words)


def test_cache_starts_anew(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 2000)
    own, texts = ByteBpe(public_tokenizers.path(NAME)), [f"word{i} {'z' * 300}{i}" for i in range(60)]
    for text in texts * 2:
        (ids,) = own.encode([text])
        assert ids == b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(text))
        assert own.cached <= 2600 and not any(len(w) > byte_bpe.KEPT_CHARS for w in own.cache)


def test_frames(spark, library):
    df = spark.createDataFrame([(1, "Hello world's end", "x"), (1, "Hello world's end", "x"), (2, "", "y"), (3, None, None), (None, "ü  \n", "z")], "doc_id long, text string, ids string")
    rows = decode(encode(df, NAME, offsets="at", round_trip="whole"), NAME).collect()
    assert len(rows) == 5
    for r in rows:
        assert list(r.ids) == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "")
        assert len(r.at) == len(r.ids) and r.whole
    made = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests(df, NAME).collect()}
    for r in df.collect():
        ids = library.encode_ordinary(r.text or "")
        assert (r.doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) in made
    assert digests(df.limit(0), NAME).count() == 0
