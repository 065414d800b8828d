import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe

CONTENT = bpe.read_ranks()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, CONTENT.splitlines())}
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(CONTENT, public_tokenizers.PATTERN)

TEXTS = [
    "",
    " ",
    "a  b\n\n c\t",
    "It's we'll they've  'd \n x",
    "Ünïcode 漢字 and 😀 <|endoftext|> 123 456.78",
    "x" * 500 + " " + "ab" * 300,
    "trailing  ",
    "\x1c y 　z\x85 q  r",
    "   a",
]


def ids(text):
    return np.frombuffer(CODEC.encode([text])[0], np.int32).tolist()


def test_equals_the_library():
    for text in TEXTS:
        assert ids(text) == ENCODING.encode_ordinary(text), text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sabcé1.,!\x1c\x85\xa0"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=60))
def test_any_text(text):
    assert ids(text) == ENCODING.encode_ordinary(text)


def test_long_pieces_take_the_same_merges():
    for piece in ("anderer" * 40, "aaab" * 90, "zqxj" * 50, "ß" * 200):
        assert CODEC._contract_long(piece.encode()) == ENCODING.encode_ordinary(piece)


def test_long_pieces_of_random_letters():
    rng = random.Random(8)
    for letters in ("ab", "aehinrst", "e", "eß漢"):
        for n in (65, 300, 3000):
            piece = "".join(rng.choice(letters) for _ in range(n))
            assert CODEC._contract_long(piece.encode()) == ENCODING.encode_ordinary(piece)


def test_segments_give_the_ids_of_the_whole():
    rng = random.Random(9)
    for _ in range(40):
        text = "".join(rng.choice(["a", "the", " ", " ", "\n", "  ", ".", "\x85", "Wort", "1"]) for _ in range(400))
        parts: list = [[], []]
        for rows, texts, more in bpe.segments([text, "b " + text], 37):
            assert all(len(t) <= 200 for t in texts)
            for r, got in zip(rows, CODEC.encode(texts, more), strict=True):
                parts[r].append(got)
        for t, got in zip((text, "b " + text), parts, strict=True):
            assert np.frombuffer(b"".join(got), np.int32).tolist() == ENCODING.encode_ordinary(t)


def test_texts_of_any_length(spark):
    """20 MB of words and 4 MB without a space, beside short texts; a worker takes them in segments."""
    rng = random.Random(10)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 9))) for _ in range(5000)]
    texts = [" ".join(rng.choices(words, k=20_000_000 // 6)), "e" * 4_000_000, "short"]
    assert len(texts[0]) > 19_000_000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for r in bpe.digests(docs).collect():
        want = ENCODING.encode_ordinary(texts[r["doc_id"]]) if r["doc_id"] != 1 else None  # the library is slow without spaces
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        if want is not None:
            assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "the cat", "x", "y")], "doc_id long, text string, _text string, __TEXT string")
    row = bpe.digests(docs, ("doc_id", "_text", "__TEXT")).first()
    assert row["_text"] == "x" and row["__TEXT"] == "y" and row["n_tokens"] == 2
    encoded = bpe.encode(docs, ("doc_id", "_text")).withColumnRenamed("_text", "_ids")
    assert bytes(bpe.decode(encoded, ("doc_id", "_ids")).first()["decoded"]) == b"the cat"


def test_the_query(spark, tmp_path):
    rows = [(1, "the cat sat", "en", 0), (2, None, "en", 0), (None, "x  y", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, _text string, n_tokens int").write.parquet(str(tmp_path / "documents.parquet"))
    got = bpe.op4_byte_bpe(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    for r in got.collect():
        text = {i: t or "" for i, t, *_ in rows}[r["doc_id"]]
        want = ENCODING.encode_ordinary(text)
        told = (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert tuple(r)[1:] == told


def test_digests_of_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "the cat", "x"), (3, "the cat", "x"), (4, "word " * 20_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in bpe.digests(docs).collect()}
    assert bpe.digests(docs).count() == 5
    for doc_id, text, _ in rows:
        text = text or ""
        want = ENCODING.encode_ordinary(text)
        assert got[doc_id]["n_tokens"] == len(want)
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(docs.limit(0)).count() == 0


def test_tables_of_ids_decode_again(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "the cat\n  sat", 3), (3, "the cat\n  sat", 3), (4, "Wörter " * 2_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded int")
    encoded = bpe.encode(docs)
    assert sorted((r["doc_id"], r["ids"]) for r in encoded.collect()) == sorted((i, ENCODING.encode_ordinary(t or "")) for i, t, _ in rows)
    assert sorted((r["doc_id"], bytes(r["decoded"]).decode()) for r in bpe.decode(encoded).collect()) == sorted((i, t or "") for i, t, _ in rows)
    absent = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {bytes(r["decoded"]) for r in bpe.decode(absent).collect()} == {b""}
