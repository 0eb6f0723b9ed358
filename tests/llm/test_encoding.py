"""Piece codec and token counts against the libraries."""

import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")
from factloom.llm.piece_codec import PieceCodec, encode_documents  # noqa: E402
from factloom.llm.token_counts import count_tokens  # noqa: E402

PARTS = ["a", "b", "c", "e", "t", "h", " ", "  ", "▁", "\n", "é", "😀", "中", "the", "ing", "\x00", "́", "    ", "1", "<s>", "</s>", "<0x41>", "\x1c", " ", "aaaa", "=", "==", "<|endoftext|>", "İ", "ß", "'S"]


def noise(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 50))) for _ in range(n)] + ["", " ", "a" * 1500, " " * 700, "ab" * 300]


def test_codec_equals_library():
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    mine, theirs = PieceCodec(model), sentencepiece.SentencePieceProcessor(model_file=model)
    for text in noise(600, 1):
        ids = theirs.encode(text)
        assert mine.encode(text) == ids
        assert mine.decode([*ids, 2]) == theirs.decode([*ids, 2])
    rng = random.Random(2)
    for _ in range(400):
        ids = [rng.choice([rng.randint(0, 31_999), rng.randint(0, 258)]) for _ in range(rng.randint(1, 9))]
        assert mine.decode(ids) == theirs.decode(ids)


def test_documents(make, odd):
    import sentencepiece
    from tokenizers import Tokenizer

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    tk = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = odd + [(100 + i, t) for i, t in enumerate(noise(60, 3)) if "\x00" not in t]
    docs = make(rows)
    got = sorted(map(tuple, encode_documents(docs, P.path("piece_bpe_32k.model")).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = sp.encode(t or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    lengths = [len(tk.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    for frequent in (100_000, 5, 0):
        counted = sorted(map(tuple, count_tokens(docs, P.path("word_bpe_49k.json"), 20, frequent).collect()), key=repr)
        assert counted == sorted([(i, len((t or "").encode()), n, n > 20) for (i, t), n in zip(rows, lengths, strict=True)], key=repr)
    assert encode_documents(make([]), P.path("piece_bpe_32k.model")).count() == 0
    assert count_tokens(make([]), P.path("word_bpe_49k.json")).count() == 0
