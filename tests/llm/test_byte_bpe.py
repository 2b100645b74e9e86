import base64
import hashlib

import public_tokenizers as P
import tiktoken

from metaloom.llm import byte_bpe as bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", None, "  a  b\n\n c\t ", "'s 're don't", "日本語テキスト ９９ ½ ²", "a" * 700, "👍🏽🇩🇪", "a\r\n\r\nb", "ʼn Ⅷ _ __x", " " * 300 + "x", "the the", "the the"]


def encoding():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library(spark):
    want = encoding()
    documents = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "a b", 1)], "doc_id long, text string, ids int")
    small = bpe.Settings(cache=3, query_bytes=50, query_tokens=20, rounds=4)
    for s in (None, small):
        ids = bpe.encode(documents, PATH, P.PATTERN, s)
        assert {r.doc_id: list(r.ids) for r in ids.collect()} == {i: want.encode_ordinary(t or "") for i, t in enumerate(TEXTS)} | {None: want.encode_ordinary("a b")}
        back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(ids, PATH, P.PATTERN, s).collect()}
        assert back == {i: t or "" for i, t in enumerate(TEXTS)} | {None: "a b"}
    for r in bpe.digest(documents.where("doc_id is not null"), PATH, P.PATTERN).collect():
        own = want.encode_ordinary(TEXTS[r.doc_id] or "")
        assert r.n_tokens == len(own)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
    assert bpe.digest(documents.limit(0), PATH, P.PATTERN).count() == 0


def test_long_words_in_pieces():
    """Words of 100,000 letters, and short ones cut small, get the library's ids."""
    import random

    want, rng = encoding(), random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)), "a" * 100_001, "ing" * 30_000, "日本語" * 9_000]
    codec = bpe.Codec(PATH, P.PATTERN, bpe.Settings())
    assert [list(x) for x in codec.encode(words)] == [want.encode_ordinary(w) for w in words]
    small = bpe.Codec(PATH, P.PATTERN, bpe.Settings(long=12, piece=7))
    words = ["".join(rng.choice(["a", "ab", "th", "e", "in", "g", "é", "日", "-"]) for _ in range(rng.randint(8, 60))) for _ in range(200)]
    assert [list(x) for x in small.encode(words)] == [want.encode_ordinary(w) for w in words]


def test_later_stages_find_no_words_in_the_worker():
    """A worker goes from stage to stage; what BPE remembers is kept for BPE alone."""
    from metaloom.llm import common

    codec = bpe.Codec.of(PATH, P.PATTERN, bpe.Settings())
    list(common.releasing(lambda frames: frames, "byte_bpe")(iter([])))
    assert bpe.Codec.of(PATH, P.PATTERN, bpe.Settings()) is codec
    list(common.releasing(lambda frames: frames)(iter([])))
    assert not bpe.Codec.held
