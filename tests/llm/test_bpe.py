import hashlib
import random
import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tracewell.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), P.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_ids_equal_the_library_on_odd_texts(codec, library):
    rnd = random.Random(1)
    letters = list("aaabcthe  \n\t'sé0١½ß漢\x1c\x85 ​😀,.-_\xa0ⅷ<|endoftext|>")
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(4000)]
    texts += ["", None, "a" * 30_000, " " * 30_000, "ab" * 20_000, "<|endoftext|>", "don't I'LL we've"]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids == library.encode_ordinary(text or "")
        assert codec.decode(ids) == (text or "").encode()


def test_merges_of_odd_rank_tables_match_the_library():
    rnd = random.Random(2)
    for _ in range(60):
        tokens = [bytes([b]) for b in range(256)]
        merged = list({bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 5))) for _ in range(25)})
        rnd.shuffle(merged)  # a longer token may come before its parts, or have none
        ranks = {t: k for k, t in enumerate(tokens + merged)}
        own, library = bpe.Codec(ranks, r"\S+|\s+"), tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        texts = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 30))) for _ in range(40)]
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert ids == library.encode_ordinary(text)


def test_replays_by_rank_and_by_place_agree(codec):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("theinon arsé") for _ in range(rnd.randint(1, 25))).encode() for _ in range(4000)]
    raw, ends = np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum([len(w) for w in words])
    first = np.full(len(raw), -1, dtype=np.int32)
    first[:-1] = codec.bytewise[raw[:-1], raw[1:]]
    first[ends - 1] = -1
    assert (codec._by_rank(raw, ends, first) == codec._by_place(raw, ends, first)).all()


def test_a_word_of_twenty_megabytes(codec):
    rnd = random.Random(4)
    part = "".join(rnd.choice("theinoarst") for _ in range(20_000))
    word = part * 1_000
    began = time.time()
    (ids,) = codec.encode([word])
    assert time.time() - began < 120
    assert codec.decode(ids) == word.encode() and len(ids) < len(word) / 2


def test_operator_round_trip(spark, library):
    texts = [(1, "Hello, wörld"), (2, None), (3, ""), (4, "x " * 50_000), (1, "Hello, wörld"), (None, "n")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, ids string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df, PATH, P.PATTERN).collect()}
    want = set()
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    encoded = bpe.encode(df, PATH, P.PATTERN)
    back = sorted(((r.doc_id or 0, bytes(r["bytes"]).decode()) for r in bpe.decode(encoded, PATH, P.PATTERN).collect()))
    assert back == sorted((i or 0, t or "") for i, t in texts)
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN).collect() == []


def test_cache_may_start_anew(monkeypatch, codec, library):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    for _ in range(3):
        assert [*codec.encode(["one two three four", "five"])] == [library.encode_ordinary(x) for x in ("one two three four", "five")]


@pytest.mark.parametrize(
    "pattern",
    [
        r"\p{L}+|\s+|[^\s\p{L}]+",
        r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+",
        r"\P{L}+|\p{L}+",
        r"\p{Lu}+|\P{Lu}+",
        r"\d+|\D+",
        r"\[\p{L}\]|[\[\]]|[^\[\]]+",
    ],
)
def test_other_patterns_split_as_the_library_does(codec, pattern):
    """No letter is dropped, wherever in the pattern its class stands."""
    own, library = bpe.Codec(codec.ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec.ranks, special_tokens={})
    rnd = random.Random(3)
    texts = ["hello World 12", "[a] [é]x"] + ["".join(rnd.choice("abC1 é'\n\t s٣_-.[]\x85\xa0Ä") for _ in range(rnd.randrange(20))) for _ in range(2000)]
    texts += ["".join(c for c in t if c < "\x80") for t in texts]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids == library.encode_ordinary(text), text
