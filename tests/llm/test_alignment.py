import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import alignment

A = Tokenizer.from_file(public_tokenizers.path(alignment.FIRST))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.SECOND))
ALIGNER = alignment.Aligner(alignment.read(alignment.FIRST), alignment.read(alignment.SECOND))


def level(entry):
    """Bytes of an entry, by the library's own decoder where it is whole UTF-8."""
    byte = alignment._byte_of()
    return bytes(byte[c] for c in entry)


def tokens(text):
    """(id, start, end) lists of both tokenizers, or two empty ones."""
    if not text:
        return [], []
    whole, out = (" " + text).encode(), []
    for ids, spell in (
        (A.encode(" " + text, add_special_tokens=False).ids, lambda i: level(A.id_to_token(i))),
        (B.encode(text), lambda i: bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()),
    ):
        at, spans = 0, []
        for i in ids:
            spans.append((i, at, at + len(spell(i))))
            at = spans[-1][2]
        if b"".join(spell(i) for i in ids) != whole:
            return [], []
        out.append(spans)
    return out[0], out[1]


def links(a, b):
    return [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]


def groups(a, b):
    ends = sorted({x[2] for x in a} & {y[2] for y in b})
    out, since = [], 0
    for end in ends:
        out.append("|".join(",".join(str(t[0]) for t in side if since <= t[1] and t[2] <= end) for side in (a, b)))
        since = end
    return ends, ";".join(out)


def brute(rows):
    parts = [(doc, *tokens(text)) for doc, text in rows]
    held = Counter(p for _, a, b in parts for p in set(links(a, b)))
    top = {}
    for (a, _), n in held.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for doc, a, b in parts:
        found = links(a, b)
        ends, text = groups(a, b)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        out.append((doc, len(a), len(b), len(ends), len(found), sum(held[p] == top[p[0]] for p in found), sum(held[p] for p in found), digest))
    return out, held, top


TEXTS = ["", None, " ", "  ", "a", "a ", "a  ", " a", "It's  two\n  spaces \n b\t c", "trailing  ", "Ünïcode 漢字 and 😀 <|endoftext|> </s> <0x41>", "▁ ▁x a▁ b", "x" * 400, "\x85 y\xa0 z　 \x1c q", "​ 1234 5.5", "é ﬁ ½", "\x00 a"]


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_units_give_the_tokens_of_the_whole(text):
    whole, parts = ALIGNER.align([text])[0], ALIGNER.documents([text])[0]
    assert whole == parts
    assert (whole is None) == (tokens(text) == ([], []))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sabcé1.,!\x1c\x85\xa0▁"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=40))
def test_any_text(text):
    if text:
        got, (a, b) = ALIGNER.documents([text])[0], tokens(text)
        assert (got is None) == (not a)
        if got:
            assert got[1][:-1].decode() == groups(a, b)[1] and len(got[2]) // 4 == len(links(a, b)) and got[0] == len(a)


def test_integers():
    values = np.array([0, 1, 127, 128, 300, 1 << 21, (1 << 35) + 5, 1 << 62])
    data, ends = alignment.varints(values)
    assert alignment.integers(data).tolist() == values.tolist() and ends[-1] == len(data)
    assert alignment.integers(alignment.varints(values[:0])[0]).tolist() == []


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "straße", "naïve", "and", "Zeit", "tokenizer", "a", "l'été", "x1y2", "漢字"] + ["".join(rng.choice("aeihnrst") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = [rng.choice([" ", " ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += TEXTS + [texts[0]] * 5
    rows = list(enumerate(texts)) + [(None, "no id"), (3, "a repeated id"), (3, "a repeated id")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "rows", "flush"), [(1, 64, 40), (2, 5000, 1 << 22)])
def test_documents_and_pairs_equal_brute_force(spark, seed, rows, flush):
    data = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x", 1, b"b") for d, t in data], "doc_id long, text string, flush string, stripe int, places binary").repartition(5)
    made = alignment.Alignment(docs, rows=rows, flush=flush)
    want, held, top = brute(data)
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in made.documents().collect()), key=key) == sorted(want, key=key)
    assert {(r["a"], r["b"]): (r["documents"], r["is_best"]) for r in made.pairs().collect()} == {p: (n, n == top[p[0]]) for p, n in held.items()}


def test_the_query(spark, tmp_path):
    data = [(k, t) for k, t in enumerate(["one two three", "two three four " * 40_000, None, "", "w" * 30_000])]
    spark.createDataFrame(data, "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in alignment.op12_token_alignment(spark, str(tmp_path)).collect()}
    assert len(got) == 5 and got[1]["n_groups"] == 120_001 and got[2]["groups_sha256"] == got[3]["groups_sha256"] == ""
    assert got[4]["n_a"] == len(A.encode(" " + "w" * 30_000).ids)
    assert alignment.Alignment(spark.createDataFrame([], "doc_id long, text string")).documents().collect() == []
