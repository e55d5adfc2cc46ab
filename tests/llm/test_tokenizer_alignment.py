import hashlib
import json
import random
from bisect import bisect_right
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from webtally.llm import tokenizer_alignment as ta
from webtally.llm.queries import table

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def vocabularies():
    return ta.read_vocabularies(A, B)


def brute(docs):
    """By the tokenizers' own offsets and decoders, and all pairs of a group one by one."""
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = ta.byte_alphabet()
    spelled = []
    for _, text in docs:
        want = (" " + (text or "")).encode()
        a = tokenizer.encode(want.decode(), add_special_tokens=False).ids
        b = pieces.encode(text or "")
        bytes_a = [bytes(alphabet[c] for c in tokenizer.id_to_token(i)) for i in a]
        bytes_b = [
            bytes.fromhex(p[3:5]) if pieces.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, pieces.id_to_piece(i)) for i in b)
        ]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            spelled.append(([], [], [], []))
            continue
        spelled.append((a, b, [0, *bytes_a], [0, *bytes_b]))
    out, pairs = [], []
    for a, b, bytes_a, bytes_b in spelled:
        def ends(tokens):
            at, found = 0, []
            for x in tokens[1:]:
                at += len(x)
                found.append(at)
            return found

        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        common = sorted(set(ends_a) & set(ends_b))
        cut, before = [], 0
        for end in common:
            cut.append(tuple(ids[bisect_right(at, before) : bisect_right(at, end)] for ids, at in ((a, ends_a), (b, ends_b))))
            before = end
        pairs.append([(x, y) for xs, ys in cut for x in xs for y in ys])
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in cut)
        out.append([len(a), len(b), len(cut), len(pairs[-1]), hashlib.sha256(written.encode()).hexdigest() if a else ""])
    counts = Counter(p for own in pairs for p in set(own))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(n, best.get(x, 0))
    rows = []
    for (i, _), (n_a, n_b, n_groups, n_links, digest), own in zip(docs, out, pairs):
        n_best = sum(counts[p] == best[p[0]] for p in own)
        rows.append((i, n_a, n_b, n_groups, n_links, n_best, sum(counts[p] for p in own), digest))
    return sorted(rows, key=str)


def result(df, vocabularies, **options):
    rows = ta.align(df, vocabularies, **options).collect()
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[n] for n in names) for r in rows), key=str)


TEXTS = [
    "Hello world, hello there.", "Hello world", "naïve  Ünïcode\n\n\ttabs", "<|endoftext|> <s> </s> <unk> <0x41>",
    "日本語のテキスト 𝔸𝔹 \U0001f600", "▁ marks ▁▁", "  leading and trailing  ", "a" * 300, "\x00\x01", " ", "Ωmega" * 20, "don't",
]


@pytest.mark.parametrize("most_common", [0, 5])
def test_equals_brute_force(spark, vocabularies, most_common):
    rng = random.Random(3)
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(rng.choices(TEXTS[:5], k=4))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert result(df, vocabularies, most_common=most_common) == brute(docs)


def test_given_documents(spark, vocabularies):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    docs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert result(df, vocabularies) == brute(docs)


def test_edge_cases(spark, vocabularies):
    docs = [(1, None), (2, ""), (None, "null id"), (3, "twice"), (3, "twice"), (4, "long word " * 30_000), (5, "x" * 50_000)]
    df = spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id bigint, text string, row string, a int")
    assert result(df, vocabularies) == brute(docs)
    assert result(df.limit(0), vocabularies) == []


def test_groups_without_common_ends_are_not_multiplied_out():
    a, b = [1, 2] * 5000, [7, 8, 9] * 4000
    found, times = ta.links(a, b, [0, len(a)], [0, len(b)])
    assert len(found) == 6 and times.sum() == len(a) * len(b)


def test_special_strings_are_plain_text(vocabularies):
    encoders = ta.Encoders(vocabularies)
    ((a, b),) = encoders.encode(["<|endoftext|>"])
    assert 50256 not in a and len(a) > 1 and len(b) > 1


def test_ranks_and_library_agree(vocabularies):
    """On every character in several places; a file that does more than merge is left to the library."""
    encoders = ta.Encoders(vocabularies)
    assert encoders.ranked is not None
    letters = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x20000, 3)]]
    texts = [f"a{c} {c}{c}1{c} {c}!" for c in letters]
    by_library = encoders.a.encode_batch_fast(texts, add_special_tokens=False)
    assert [x.ids for x in by_library] == [encoders.ranked.encode_ordinary(t) for t in texts]
    written = json.loads(vocabularies.a)
    assert ta._ranked(written | {"normalizer": {"type": "NFC"}}) is None


def test_parts_give_what_whole_texts_give(vocabularies):
    """Blanks in runs, at both ends and beside other white space, marks of B in the text, and parts that are long or forgotten."""
    rand = random.Random(7)
    letters = "ab  \n\t▁\xa0　\x1ć\xe9漢\U0001f642‍'s1 .,\x00\x85Z<s></s>"
    texts = ["".join(rand.choice(letters) for _ in range(rand.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * n + " " + "b " * k for n in (1, 39, 40, 41, 500) for k in (0, 1, 3)]
    encoders = ta.Encoders(vocabularies)
    assert encoders.parted
    aligner = ta.Aligner(encoders, known_parts=500)
    by_parts = [x for i in range(0, len(texts), 100) for x in aligner.align(texts[i : i + 100])]
    encoders.parted = False
    for text, part, whole in zip(texts, by_parts, ta.Aligner(encoders).align(texts), strict=True):
        assert part[:4] == whole[:4], text
        assert part.pairs.tolist() == whole.pairs.tolist() and part.times.tolist() == whole.times.tolist(), text
