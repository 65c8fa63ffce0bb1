"""Token counts and packing, against the tokenizers themselves."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from rollcall.llm import packing, queries, token_counts
from tests.conftest import SF

PIECE, BYTE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
EDGES = [(None, None), (1, ""), (2, " "), (2, " "), (3, "a <s> </s> <|endoftext|> b"), (4, "愛 ▁▁ \t\n é" * 40), (5, "word " * 9000), (6, "x" * 5000)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in EDGES], "doc_id long, text string, n_tokens string, piece int")


def test_chunks_agree_with_whole_texts():
    import sentencepiece

    whole, count, draw = sentencepiece.SentencePieceProcessor(model_file=PIECE), token_counts.Counter(PIECE, 200, 16), random.Random(1)
    assert count.proven
    for k in range(300):
        letters = draw.choice(["ab c", "the of  an\nd é", "x▁ \t", "愛 b", "abc", "a "])
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 2500)))
        assert count([text]) == [len(whole.encode(text))], (k, text)


def test_token_counts(spark, edges):
    import sentencepiece

    whole = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = sorted(map(tuple, token_counts.count_tokens(edges, PIECE, chunk=500, overlap=20).collect()), key=repr)
    want = [(i, len((t or "").encode()), n := len(whole.encode(t or "")), n > 4096) for i, t in EDGES]
    assert got == sorted(want, key=repr)
    assert token_counts.count_tokens(edges.limit(0), PIECE).count() == 0


def test_token_counts_of_the_table(spark):
    import sentencepiece

    whole = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    got = {r.doc_id: r.n_tokens for r in queries.op2_token_counts(spark, SF).collect()}
    assert got == {i: len(whole.encode(t or "")) for i, t in texts.items()}


def test_fast_ids_are_the_ids():
    encode, draw = packing.Encoder(BYTE), random.Random(2)
    known = [chr(i) for i in (9, 10, 13, *range(32, 127), *range(0xA0, 0x250))]
    assert all(encode.PLAIN.fullmatch(c) for c in known)
    texts = [t for c in known for t in (c, c + c, f"a{c}b {c} 1{c}'s{c}\n{c}{c} x")]
    texts += ["".join(draw.choice(known) if draw.random() < 0.6 else draw.choice([" ", "the", "'s", "12", "\n"]) for _ in range(200)) for _ in range(500)]
    for text in [*texts, "a<|endoftext|>b", "愛\x85  x", "\x1c \x0b"]:
        assert encode(text).tolist() == encode.exact.encode(text, add_special_tokens=False).ids, repr(text)


def test_fullest_is_the_best_sum():
    draw = random.Random(3)
    for _ in range(200):
        counts = {draw.randint(1, 30): draw.randint(1, 4) for _ in range(draw.randint(0, 6))}
        room = draw.randint(0, 60)
        found = packing.fullest(counts, room)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        assert all(n <= counts[k] for k, n in found.items())
        assert sum(k * n for k, n in found.items()) == max(s for s in sums if s <= room)


def checked(docs, rows, capacity):
    """Pieces hold every id once, in order, and lie in their sequences without gaps. The number of sequences."""
    encode = packing.Encoder(BYTE).exact
    want = sorted(
        ((i, (*encode.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in docs), key=repr
    )
    got = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    at = {}
    for r in got:
        assert r.offset == at.get(r.sequence_id, 0) and r.offset + r.length <= capacity
        at[r.sequence_id] = r.offset + r.length
    pieces = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.piece), []).append(r)
    for doc, ids in want:
        size, k, start = len(ids), 0, 0
        while start < size:
            length = (size - start - 1) % capacity + 1
            crc = zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            held = pieces[doc, k]
            mine = next(r for r in held if (r.start, r.length, r.ids_crc32) == (start, length, crc))
            held.remove(mine)
            start, k = start + length, k + 1
    assert not any(pieces.values())
    return len(at)


def test_packing(spark, edges):
    rows = packing.pack(edges, BYTE, capacity=64, salts=3).collect()
    least = -(-sum(r.length for r in rows) // 64)
    assert checked(EDGES, rows, 64) <= least + 1
    assert packing.pack(edges.limit(0), BYTE).count() == 0


def test_packing_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    rows = queries.op7_packing(spark, SF).collect()
    assert checked(docs, rows, 2048) == -(-sum(r.length for r in rows) // 2048)


def test_packing_of_one_hot_length(spark):
    docs = spark.createDataFrame([(i, "same text here") for i in range(500)], "doc_id long, text string")
    rows = packing.pack(docs, BYTE, capacity=10, salts=5).collect()
    assert checked([(i, "same text here") for i in range(500)], rows, 10) == 250
