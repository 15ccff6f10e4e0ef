import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm.bpe import digest, encode_decode, model

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def chunks():
    with open(PATH, encoding="utf-8") as f:
        return model(f.read())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(5)
    kinds = ["abcdefghij'st re ve", "ABC xyz 0123", "äöüßéèñçÀÉ", "ΑΒΣς σ", "İKẞ", "éä́ ", "日本語テスト", "👍🏽👩‍👩‍👧", "!?.,;:#*$%&|<>'", " \t\n\x0b\x0c\r\x1c\x1d\x85\xa0  　", "²½Ⅷ٣", "‍­﻿\x00\x01"]
    yield from ["", " ", "I'm we'll DON'T it's 's'T", "<|endoftext|> a<|startoftext|>b <|endoftext", "a" * 3000, "supercalifragilistic" * 40, "thththananinerrere" * 30]
    for _ in range(1500):
        alphabet = "".join(rng.sample(kinds, rng.randint(1, 4)))
        yield "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))


def test_equals_library(chunks, library):
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        n, packed, decoded = digest(t, chunks)
        assert list(struct.unpack(f"<{n}I", packed)) == ids, t
        assert decoded == library.decode(ids, skip_special_tokens=False), t


def test_prefix_tokens_equal_merging(chunks):
    rng = random.Random(1)
    for _ in range(500):
        word = bytes(rng.choice(b"aeinorstth") for _ in range(rng.randint(1, 25)))
        codes = "".join(map(chr, word[:-1])) + chr(256 + word[-1])
        assert chunks.bpe.encode_piece(word) == chunks.bpe.merged(codes)


def test_frame(spark, library):
    rows = [(1, "Hello there"), (1, "Hello there"), (2, None), (3, ""), (None, "x" * 5000)]
    d = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = encode_decode(d, PATH).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), ids))
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.ids) for r in got), key=key) == sorted(want, key=key)
    assert encode_decode(d.limit(0), PATH, ids=False).count() == 0


def test_letters_are_those_of_the_splitter():
    import regex

    letter = regex.compile(r"\p{L}")
    assert all(letter.match(chr(c)) for c in range(0x110000) if chr(c).isalpha())


def test_words_and_marks(chunks, library):
    words = ["Straße", "ÉCOLE", "Σίσυφος", "ΟΔΟΣ", "İstanbul", "naïve", "日本", "Ⅷ", "áb", "x‍b", "ǅ"]
    for w in words:
        for mark in ["", ".", ",", "'", "'s", "!", "?!", "-", "_", "|", "<", ">", "…", "1", "&&&", "!!", "?'", "%$#", "<|", "--'s"]:
            ids = library.encode(w + mark, add_special_tokens=False).ids
            n, packed, _ = digest(w + mark, chunks)
            assert list(struct.unpack(f"<{n}I", packed)) == ids, w + mark


def test_few_are_kept(monkeypatch, library):
    from quarry.llm import bpe

    for name, n in (("KEEP_PIECES", 2), ("PAIRS", 3)):
        monkeypatch.setattr(bpe, name, n)
    with open(PATH, encoding="utf-8") as f:
        few = bpe.Chunks(bpe.Bpe(f.read()), 4)
    for t in list(texts())[:200]:
        assert digest(t, few)[0] == len(library.encode(t, add_special_tokens=False).ids) and len(few) <= 4
