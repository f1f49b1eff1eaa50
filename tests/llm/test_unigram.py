import random
import struct

import numpy as np
import sentencepiece
from pyspark.sql import functions as F

from concord.llm import unigram
from concord.llm.queries import VOCABULARY

DATA = "/root/testdata/sf0.01"


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def packed(number, value):
    return varint(number << 3 | 2) + varint(len(value)) + value


def as_unigram(path, vocab):
    """The same pieces and our scores as a unigram model for the public library."""
    out, i = b"", 0
    with open(path, "rb") as f:
        data = f.read()
    for number, value in unigram._fields(data):
        if number == 1:
            kind = dict(unigram._fields(value)).get(3, 1)
            out += packed(1, packed(1, vocab.pieces[i]) + b"\x15" + struct.pack("<f", vocab.score[i]) + b"\x18" + varint(kind))
            i += 1
        elif number == 2:
            trainer = b""
            for n, v in unigram._fields(value):
                v = 1 if n == 3 else v
                if isinstance(v, int):
                    trainer += varint(n << 3) + varint(v)
                elif n not in (10, 15):
                    trainer += packed(n, v) if len(v) != 4 else b""
            out += packed(2, trainer)
        else:
            out += packed(number, value)
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def plain(vocab, text):
    """Best score by the textbook recursion over the whole marked text, without units, trie or arrays."""
    score = {p: vocab.score[i] for i, p in enumerate(vocab.pieces) if vocab.text_of[i] == p}
    chars = unigram.MARK + text.replace(" ", unigram.MARK)
    best = [0.0] + [-1e300] * len(chars)
    for q in range(1, len(chars) + 1):
        for p in range(max(0, q - 20), q):
            got = score.get(chars[p:q].encode())
            if got is None and q - p == 1:
                got = vocab.unknown
            if got is not None:
                best[q] = max(best[q], best[p] + got)
    return best[-1]


def test_whole_table_against_the_public_library_and_round_trip(spark):
    vocab = unigram.load(VOCABULARY)
    judge = as_unigram(VOCABULARY, vocab)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    coded = unigram.encode(docs, vocab)
    back = unigram.decode(coded.select("text", "ids"), vocab)
    assert back.where(~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0
    rows = coded.select("text", "ids", "log_score").collect()
    score = np.where(np.isin(np.arange(len(vocab.score)), vocab.byte_id), 0, vocab.score)
    same = 0
    for r in rows:
        want = judge.encode(r["text"])
        same += want == r["ids"]
        # where the paths differ they tie, up to the library's single precision
        np.testing.assert_allclose(score[r["ids"]].sum(), score[want].sum(), rtol=1e-6)
    assert same > 0.9 * len(rows)


def test_scores_against_the_recursion():
    vocab = unigram.load(VOCABULARY)
    rng = random.Random(4)
    bits = ["the", " ", "  ", "\n", "é", "😀", "a", "tion", "▁", "\x00", "中", "zz", "."]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(300)]
    ids, ends, scores = unigram.encode_batch(vocab, texts)
    np.testing.assert_allclose(scores, [plain(vocab, t) for t in texts], rtol=1e-9)
    for t, part in zip(texts, np.split(ids, ends[:-1]), strict=True):
        assert unigram.decode_ids(vocab, part.tolist()) == t.replace(unigram.MARK, " ")


def test_long_units_equal_short_ones():
    vocab = unigram.load(VOCABULARY)
    rng = random.Random(7)
    units = ["".join(rng.choices(["the", "é", "😀", "a", "tion", "中", "zz", "\x00"], k=40)).encode() for _ in range(60)]
    ids, ends, scores = unigram.segment(vocab, units)
    for unit, part, score in zip(units, np.split(ids, ends[:-1]), scores, strict=True):
        one, total = unigram._segment_one(vocab, unit)
        assert one.tolist() == part.tolist() and total == score


def test_edges(spark):
    vocab = unigram.load(VOCABULARY)
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (3, " ", None), (None, "a" * 60_000, "y"), (5, "word " * 30_000, "y"), (6, "\n\n \n", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = unigram.encode(docs, vocab)
    got = unigram.decode(coded, vocab).select("doc_id", "text", "decoded").collect()
    assert len(got) == 7 and all(r["text"] == r["decoded"] for r in got)
    assert unigram.decode(unigram.encode(docs.limit(0), vocab), vocab).count() == 0
