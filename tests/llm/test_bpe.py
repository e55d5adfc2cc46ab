import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from webtally.llm import bpe

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
BITS = [*map(chr, range(0x20, 0x7F)), "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "　", "é", "ß", "中文", "😀", "²", "Ⅷ", "́",
        "<|endoftext|>", "'s", "'ll", "  ", "aaaa", "the ", "ɏ", "ɐ", "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_encodes_and_decodes_as_the_library(library):
    rng, own = random.Random(1), bpe.codec(VOCABULARY)
    texts = ["".join(rng.choices(BITS, k=rng.randrange(40))) for _ in range(3000)] + ["a" * 20_000, " " * 5000, "ab" * 9000]
    for text, ids in zip(texts, own.encode_batch(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text[:50]
        assert own.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False) == text
    for _ in range(500):
        ids = [rng.randrange(50_257) for _ in range(8)]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_entry_is_its_own_encoding():
    own = bpe.codec(VOCABULARY)
    ids, counts = own.encode_pieces(list(own.ids))
    assert ids.tolist() == list(own.ids.values()) and set(counts.tolist()) == {1}


def test_edge_cases(spark, library):
    rows = [(1, None, 0), (2, "", 0), (None, "a b", 1), (4, "x y", 2), (4, "x y", 2), (5, "long " * 100_000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    encoded = bpe.encode(df, VOCABULARY)
    got = sorted(((r["doc_id"], r["ids"]) for r in encoded.collect()), key=str)
    assert got == sorted(((i, library.encode(t or "").ids) for i, t, _ in rows), key=str)
    decoded = sorted(map(tuple, bpe.decode(encoded, VOCABULARY).collect()), key=str)
    assert decoded == sorted(((i, t or "") for i, t, _ in rows), key=str)
    assert bpe.round_trip(df.limit(0), VOCABULARY).count() == 0
