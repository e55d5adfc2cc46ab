import random

import numpy as np
import pyarrow as pa
import pytest

from webtally.llm import blocks, ngram_join, queries, wording
from webtally.llm.components import components
from webtally.llm.ngram_join import join

BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    for c in BLANKS:
        text = text.replace(c, " ")
    return [bytes(w, "utf-8").lower() for w in text.split(" ") if w]


def shingles(text, n=5):
    w = words(text or "")
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(docs, threshold=0.8):
    """class and number of links of every document, by comparing all of them through an index of shingles."""
    sets = {i: shingles(t) for i, t in docs}
    index = {}
    for i, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(i)
    links = {i: set() for i in sets}
    for i, s in sets.items():
        for j in {j for x in s for j in index[x] if j > i}:
            common = len(s & sets[j])
            if 5 * common >= 4 * (len(s) + len(sets[j]) - common) if threshold == 0.8 else 0:
                links[i].add(j)
                links[j].add(i)
    label = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = i
                todo += links[x]
    return {i: (label[i], len(links[i]), label[i] == i) for i in links}


def result(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"], r["kept"]) for r in df.collect()}


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def sample(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    expected = brute(docs)
    assert any(n for _, n, _ in expected.values())
    assert result(queries.op1_ngram_join(spark, sf_dir)) == expected


def test_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 16)
    rng = random.Random(5)
    base = sample(rng, 150)
    docs = [(i, edited(rng, base, rng.randrange(6))) for i in range(150)]
    docs += [(1000 + i, base) for i in range(60)] + [(2000 + i, sample(rng, 60)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert result(join(df)) == brute(docs)


def test_edge_cases(spark):
    docs = [
        (1, None, "a"), (2, "", "b"), (3, " \n\t", None), (4, "one two", "d"), (5, "ONE\ttwo ", "e"), (6, "one", "f"),
        (7, "a b c d e f g", "x"), (8, "a b c d e f g", "x"), (8, "a b c d e f g", "x"), (9, "É a b c d", "y"), (10, "é a b c d", "y"),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, class string")
    found = result(join(df))
    assert found == brute([d[:2] for d in docs])
    assert found[8] == (7, 1, False) and found[5] == (4, 1, False) and found[10] == (10, 0, True)
    assert join(df.limit(0)).count() == 0

    without = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b")], "doc_id bigint, text string")
    rows = sorted(map(tuple, join(without).collect()), key=str)
    assert rows == [(3, 3, 0, True), (None, None, 0, True), (None, None, 0, True)]


def test_very_long_text(spark):
    rng = random.Random(6)
    long = sample(rng, 200_000)
    docs = [(1, long), (2, edited(rng, long, 500)), (3, "x" * 1_000_000), (4, "x" * 1_000_000)]
    found = result(join(spark.createDataFrame(docs, "doc_id bigint, text string")))
    assert found == {1: (1, 1, True), 2: (1, 1, False), 3: (3, 1, True), 4: (3, 1, False)}


def test_other_names_and_string_keys(spark):
    docs = spark.createDataFrame([("b", "x y z"), ("a", "x y z")], "`the key` string, body string")
    assert result(join(docs, key="the key", text="body")) == {"a": ("a", 1, True), "b": ("a", 1, False)}


def test_pruning_keeps_what_may_reach_the_threshold():
    fewest = ngram_join.fewest_matches(0.8, 1e-7)
    assert list(fewest) == sorted(fewest) and 0 < fewest[0] < 0.8 * ngram_join.STEP
    # a pair at the threshold is dropped at any look with a chance far below one in a million
    rng = np.random.default_rng(1)
    matches = np.cumsum(rng.random((200_000, ngram_join.HASHES)) < 0.8, axis=1)[:, ngram_join.STEP - 1 :: ngram_join.STEP]
    assert (matches < np.array(fewest)).any(axis=1).mean() < 1e-4


@pytest.mark.parametrize("two_blocks", [False, True])
@pytest.mark.parametrize("band", [0, 1, 5])
def test_pairs_of_a_group_equal_those_compared_one_by_one(monkeypatch, band, two_blocks):
    monkeypatch.setattr(ngram_join, "PAIRS", 50)
    rng = np.random.default_rng(band)
    base = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    sets = []
    for _ in range(40):
        own, n = base.copy(), rng.integers(0, 25)
        own[rng.choice(120, n, replace=False)] = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets.append(np.unique(own))
    values = np.stack([ngram_join.signature(x) for x in sets])
    values[:, band * 4 : band * 4 + 4] = values[0, band * 4 : band * 4 + 4]
    side = np.arange(40) % 2 if two_blocks else np.zeros(40, int)
    fewest = ngram_join.fewest_matches(0.8, 1e-7)

    def survives(a, b):
        same = values[a] == values[b]
        return not same.reshape(-1, 4)[:band].all(axis=1).any() and all(
            same[: (i + 1) * ngram_join.STEP].sum() >= least for i, least in enumerate(fewest)
        )

    pairs = [(a, b) for a in range(40) for b in range(40) if (side[a] < side[b] if two_blocks else a < b)]
    left, right = ngram_join.surviving(values, side, band, 0.8, 1e-7)
    found = list(zip(left.tolist(), right.tolist()))
    assert sorted(found) == [p for p in pairs if survives(*p)] and found
    near = ngram_join.reaching(sets, left, right, 0.8)
    shared = [len(np.intersect1d(sets[a], sets[b])) for a, b in found]
    assert near.tolist() == [10 * c >= 8 * (len(sets[a]) + len(sets[b]) - c) for c, (a, b) in zip(shared, found)]


def test_words_equal_those_of_a_plain_split():
    rng = random.Random(2)
    texts = ["".join(rng.choices("aAbB é😀 \t\n\x0b\x0c\r\x1c\x85.", k=rng.randrange(30))) for _ in range(300)] + [None, ""]
    array = pa.array(texts)
    seen = {}
    for first, rows, hashes, row, start in wording.words_of(array):
        bounds = wording.per_row(row, rows)
        for i in range(rows):
            own = words(texts[first + i] or "")
            assert bounds[i + 1] - bounds[i] == len(own)
            raw = (texts[first + i] or "").encode()
            for h, s, w in zip(hashes[bounds[i] : bounds[i + 1]], start[bounds[i] : bounds[i + 1]], own):
                assert seen.setdefault(int(h), w) == w
                assert raw[s : s + len(w)].lower() == w
    assert len(set(seen.values())) == len(seen)
    assert [len(x[2]) for x in wording.words_of(array.slice(3, 2))] == [len(words(texts[3])) + len(words(texts[4]))]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 560)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)] + [(7, 7), (None, 3)]
    label = {}
    for a, b in edges:
        if a is not None:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(300):
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {r["node"]: r["root"] for r in components(df).collect()} == {n: r for n, r in label.items() if n != r}
    assert components(df.limit(0)).count() == 0


@pytest.mark.parametrize("cut", [1, 2, 3, 7])
def test_groups_across_batches(cut):
    table = pa.table({"g": [1, 1, 2, 3, 3, 3, 3, 4], "x": list(range(8))})
    groups = [g["x"].to_pylist() for g in blocks.groups_of(iter(table.to_batches(max_chunksize=cut)), ["g"])]
    assert groups == [[0, 1], [2], [3, 4, 5, 6], [7]]


def test_blocks_without_rows(spark, monkeypatch):
    # Two long texts in a bucket of many blocks, as from some 300,000 words each on.
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 16)
    monkeypatch.setattr(ngram_join, "GRAMS_OF_A_MEMBER", 4)
    rng = random.Random(8)
    docs = []
    for i in range(60):
        base = sample(rng, 150)
        docs += [(2 * i, base), (2 * i + 1, edited(rng, base, 2))]
    assert result(join(spark.createDataFrame(docs, "doc_id bigint, text string"))) == brute(docs)


def test_only_a_block_with_itself_pairs_rows_of_one_side():
    side = np.zeros(3, np.int32)
    assert [len(x) for x in blocks.pairs_in(side, False)] == [0, 0]
    assert [len(x) for x in blocks.sides(side, False)] == [3, 0]
    assert len(blocks.pairs_in(side, True)[0]) == 3
