"""Pieces encoded one after another, against the encoding by the definition."""

import random

from pagewright.llm import byte_bpe


def test_pieces_that_begin_alike_share_their_work():
    ranks = {bytes([k]): k for k in range(256)}
    ranks |= {t: 256 + k for k, t in enumerate([b"ab", b"bc", b"abc", b"ca", b"cab", b"aa", b"abab", b"bcab"])}
    vocabulary, draw = byte_bpe.Vocabulary(ranks), random.Random(7)
    words = ["".join(draw.choice("abc\xe9") for _ in range(draw.randint(1, 9))) for _ in range(600)] + ["abc" * 30]
    pieces = byte_bpe._Pieces(vocabulary)
    pieces.learn(set(words))
    assert {w for w in words if len(w.encode()) <= byte_bpe.CACHED_PIECE_BYTES} == set(pieces)
    encode = byte_bpe.PieceEncoder(vocabulary).encode
    for word in words:
        assert list(pieces[word]) == vocabulary.merged(word.encode()) == encode(word.encode())
