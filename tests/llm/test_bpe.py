import random

import pytest
import tiktoken

from scenelake.llm.bpe import ByteBPE, encode, explicit, load_ranks, public_vocabulary, round_trip

PATH, PATTERN = public_vocabulary()


@pytest.fixture(scope="module")
def both():
    ranks = load_ranks(PATH)
    return ByteBPE(ranks, PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    kinds = ["abcdefghij ", "aab ", "éüß ñ\xa0\x85", "中文字 е ї", "\U0001f600‍ a", "\t\n  \x1c\x1f x", "0123²½ ٣", "'sl rem!?"]
    out = ["", " ", "\n\n  a", "don't we'll", "<|endoftext|>", "a" * 3000, "ab" * 700, " " * 500, "\U0001f600" * 40, "é" * 30]
    for _ in range(600):
        kind = "".join(rng.sample(kinds, 2))
        out.append("".join(rng.choice(kind) for _ in range(rng.randrange(1, 90))))
    return out


def test_ids_are_those_of_the_library(both):
    bpe, library = both
    sample = texts()
    for text, ids in zip(sample, bpe.encode_batch(sample)):
        assert ids == library.encode_ordinary(text), text
        assert bpe.decode(ids) == text.encode()


def test_long_and_short_paths_agree(both):
    bpe, _ = both
    pieces = [t.encode()[:60] for t in texts() if len(t.encode()) > 1]
    assert bpe.encode_short(pieces) == [bpe.encode_long(p) for p in pieces]


def test_patterns_agree_on_latin_text(both):
    bpe, _ = both
    rng = random.Random(6)
    for _ in range(500):
        text = "".join(chr(rng.randrange(256)) for _ in range(80))
        assert bpe.split_latin(text) == bpe.split_any(text)
    assert r"\s" not in explicit(PATTERN, "x")


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "hello  world", "y"), (3, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    got = sorted(map(tuple, encode(df, ["doc_id"]).collect()), key=str)
    assert [len(ids) for _, ids in got] == [0, 0, 0, 3]
    assert round_trip(df.limit(0), ["doc_id"]).count() == 0
