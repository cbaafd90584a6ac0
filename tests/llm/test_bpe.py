import hashlib

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from kinelake.llm import bpe, token_histogram
from kinelake.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_multi_50k.tiktoken")
CODEC = bpe.Codec(bpe.read_ranks(PATH))
WHOLE = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.read_ranks(PATH)), special_tokens={})


def test_pattern_is_the_published_one():
    import public_tokenizers

    assert bpe.PATTERN == public_tokenizers.PATTERN


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab's  \n\t\r 　é1٣!.漢😀")), max_size=60), st.integers(1, 9))
def test_pieces_encode_as_the_whole(text, size):
    parts = list(bpe.pieces(text, size))
    assert "".join(parts) == text
    assert [t for p in parts for t in WHOLE.encode_ordinary(p)] == WHOLE.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", "word " * 100_000, "a" * 200_000, "<|endoftext|> x", "é漢😀\n" * 30_000])
def test_round_trip_of_long_texts(text):
    ids = CODEC.encode(text)
    assert ids == WHOLE.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_raw_bytes_decode_without_replacement():
    byte = CODEC.encoding.encode_single_token(b"\xc3")
    assert CODEC.decode([byte]) == b"\xc3"


ROWS = [(1, "Hello world"), (2, None), (3, ""), (None, "Ünïcode 漢"), (1, "Hello world"), (5, "x y " * 40_000)]


def test_query_columns(spark):
    docs = spark.createDataFrame([(i, t, "n") for i, t in ROWS], "doc_id long, text string, n_tokens string")
    got = bpe.round_trip(docs, PATH).collect()
    assert len(got) == len(ROWS)
    want = sorted((str(i), len(ids := WHOLE.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    back = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted(bytes(r["raw"]) for r in back) == sorted((t or "").encode() for _, t in ROWS)
    kept = bpe.encode_columns(docs, PATH, ["doc_id"]).collect()
    assert all(r["lossless"] for r in kept) and len(kept) == len(ROWS)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(docs, PATH).count() == 0
    sums = token_histogram.suffix_sums(token_histogram.histogram(token_histogram.encoded_lengths(docs, PATH)))
    assert sums.count() == 0
    assert token_histogram.answer(sums, [10], [0.5]) == ({10: {"docs": 0, "tokens": 0, "docs_over": 0, "truncated_tokens": 0}}, {0.5: None})


def test_histogram_answers_equal_brute_force(spark):
    texts = [None, "", *["tok " * n for n in (1, 1, 3, 700, 700, 1500, 40)]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    lengths = sorted(len(WHOLE.encode_ordinary(t or "")) for t in texts)
    sums = token_histogram.suffix_sums(token_histogram.histogram(token_histogram.encoded_lengths(docs, PATH))).cache()
    assert [r["n_tokens"] for r in sums.orderBy("n_tokens").collect()] == sorted(set(lengths))
    for row in sums.collect():
        n = row["n_tokens"]
        assert row["n_docs"] == lengths.count(n)
        assert (row["docs_from"], row["tokens_from"]) == (sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert (row["docs_up_to"], row["truncated_tokens"]) == (sum(x <= n for x in lengths), sum(min(x, n) for x in lengths))
    limits, quantiles = [0, 2, 100, 701, 10_000], [0.1, 0.5, 0.9, 1.0]
    above, at = token_histogram.answer(sums, limits, quantiles)
    for limit in limits:
        assert above[limit]["docs_over"] == sum(x > limit for x in lengths)
        assert above[limit]["truncated_tokens"] == sum(min(x, limit) for x in lengths)
    for q in quantiles:
        assert at[q] == lengths[-(-int(q * 1000) * len(lengths) // 1000) - 1]
