import random
import re

import numpy as np
import pytest

from webtally.llm import decontaminate, queries
from webtally.llm.decontaminate import align, contaminated, without_test_items


def words(text):
    return [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text or "")]


def smith_waterman(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, above[j - 1] + (2 if x == y else -1), above[j] - 1, row[j - 1] - 1))
        best, above = max(best, *row), row
    return best


def brute(docs, items, threshold=0.5):
    """Pairs by aligning every document with every item that shares three words in a row with it."""
    pairs = {}
    own = {i: words(t) for i, t in items}
    runs = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w in own.items()}
    for d, text in docs:
        w = words(text)
        have = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
        for i, item in own.items():
            if len(item) >= 8 and have & runs[i]:
                score = smith_waterman(item, w) / (2 * len(item))
                if score >= threshold:
                    pairs[d, i] = score
    return pairs


def result(df):
    return {(r["doc_id"], r["item_id"]): r["score"] for r in df.collect()}


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = lambda name: [tuple(r)[:2] for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]
    expected = brute(rows("documents"), rows("benchmark"))
    assert expected and result(queries.op4_decontaminate(spark, folder)) == expected


def test_alignment_equals_the_plain_recurrence():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 12))]
        bs = [[rng.randrange(6) for _ in range(rng.randrange(1, 20))] for _ in range(4)]
        best, last = align(np.array(a, np.uint64), [np.array(b, np.uint64) for b in bs])
        assert best.tolist() == [smith_waterman(a, b) for b in bs]
        for b, s, e in zip(bs, best, last):
            assert not s or smith_waterman(a, b[: e + 1]) == s


def sample(rng, n):
    return [f"w{rng.randrange(3000)}" if rng.random() < 0.6 else rng.choice(["the", "of", "and", "to"]) for _ in range(n)]


def edited(rng, w, share):
    out = []
    for x in w:
        kind = rng.random() / share if share else 9
        if kind < 0.5:
            out.append(f"x{rng.randrange(10**6)}")
        elif kind < 0.75:
            out += [x, "added"]
        elif kind >= 1:
            out.append(x)
    return out


def test_planted_copies_are_found_and_clean_documents_left(spark):
    rng = random.Random(3)
    items = [(i, " ".join(sample(rng, rng.randrange(20, 60)))) for i in range(40)]
    docs, planted = [], set()
    for d in range(300):
        w = sample(rng, rng.randrange(5, 400))
        if d % 3 == 0:
            i = d // 3 % 40
            at = rng.randrange(len(w))
            w[at:at] = [x.capitalize() + rng.choice(["", ",", "."]) for x in edited(rng, items[i][1].split(), rng.choice([0, 0.1, 0.2]))]
            planted.add((d, i))
        docs.append((d, " ".join(w)))
    df, bm = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id int, text string")
    expected = brute(docs, items)
    found = result(contaminated(df, bm))
    assert found == expected and planted <= found.keys()
    kept = {r["doc_id"] for r in without_test_items(df, bm).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in found}
    # in blocks of a few items, the same
    assert result(contaminated(df, bm, block_bytes=2000)) == expected


def test_item_that_is_in_most_documents(spark):
    rng = random.Random(4)
    common = " ".join(sample(rng, 30))
    docs = [(d, " ".join(sample(rng, 50)) + " " + common + " " + " ".join(sample(rng, 20))) for d in range(200)]
    bm = spark.createDataFrame([(1, common)], "item_id int, text string")
    found = result(contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), bm))
    assert found == {(d, 1): 1.0 for d in range(200)}


def test_edge_cases(spark):
    rng = random.Random(5)
    item = " ".join(sample(rng, 30))
    long = " ".join(sample(rng, 150_000))
    docs = [
        (1, None, 0), (2, "", 0), (None, item, 0), (4, item, 1), (4, item, 1), (5, item + " " + item, None),
        (6, long + " " + item, 2), (7, "of the and", 3), (8, item.upper().replace(" ", "\n\n--"), 4),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    items = [(1, item), (1, item), (2, None), (3, ""), (4, "of the and"), (None, item)]
    bm = spark.createDataFrame(items, "item_id int, text string")
    found = sorted(((r["doc_id"], r["item_id"], r["score"]) for r in contaminated(df, bm).collect()), key=str)
    assert found == sorted([(d, i, 1.0) for d in (None, 4, 4, 5, 6, 8) for i in (1, None)], key=str)
    where = {r["doc_id"]: (r["first_word"], r["last_word"]) for r in contaminated(df, bm).collect()}
    assert where[5] == (0, 29) and where[6] == (150_000, 150_029)
    kept = without_test_items(df, bm)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 7]
    for d, b in ((df.limit(0), bm), (df, bm.limit(0)), (df, bm.where("item_id = 2"))):
        assert contaminated(d, b).count() == 0
        assert without_test_items(d, b).count() == d.count()


@pytest.mark.parametrize("length", [200, 3000])
def test_long_items_are_searched_in_passages(spark, length):
    rng = random.Random(length)
    w = sample(rng, length)
    bm = spark.createDataFrame([(1, " ".join(w))], "item_id int, text string")
    docs = spark.createDataFrame([(1, " ".join(w[-140:])), (2, " ".join(sample(rng, 500)))], "doc_id int, text string")
    assert {d for d, _ in result(contaminated(docs, bm))} == {1}


def test_seeds_cover_every_stretch_of_an_item():
    rng = np.random.default_rng(2)
    passages = decontaminate.passages_of([(1, " ".join(sample(random.Random(1), 90)))])
    distinct = np.unique(passages.gram)
    seeds = decontaminate.with_rare_seeds(passages, distinct, rng.integers(0, 50, len(distinct)))
    at = np.sort(seeds.at)
    assert len(at) < 88 and at[0] < 4 and at[-1] >= 84 and np.diff(at).max() <= decontaminate.SEED_EVERY


@pytest.mark.parametrize("edit", [5, 6, 0.2, 0.25])
def test_items_that_leak_as_one_edited_copy_only(spark, edit):
    rng = random.Random(7)
    items = [(i, sample(rng, n)) for i, n in enumerate([15, 20, 30, 59, 60] * 8)]
    docs = []
    for i, item in items:
        changed = [rng.random() < edit if edit < 1 else k % edit == edit - 1 for k in range(len(item))]
        copy = [f"x{rng.randrange(10**6)}" if c else w for w, c in zip(item, changed)]
        docs.append((i, sample(rng, 20) + copy + sample(rng, 20)))
    scores = {(d, i): smith_waterman(item, w) / (2 * len(item)) for d, w in docs for i, item in items}
    expected = {pair: score for pair, score in scores.items() if score >= 0.5}
    assert len(expected) >= 30
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id bigint, text string")
    bm = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id int, text string")
    assert result(contaminated(df, bm)) == expected


def test_runs_without_a_document_displace_no_seed():
    passages = decontaminate.passages_of([(1, " ".join(sample(random.Random(1), 60)))])
    distinct = np.unique(passages.gram)
    n_docs = np.zeros(len(distinct), np.int64)
    n_docs[np.searchsorted(distinct, passages.gram[passages.at % 5 == 2])] = 1000
    seeds = decontaminate.with_rare_seeds(passages, distinct, n_docs)
    assert sorted(seeds.at.tolist()) == list(range(2, 58, 5))


HAN = "[\u4e00-\u9fff\u3040-\u30ff\u0e00-\u0eff\U00020000-\U0003ffff]"


def characters_or_words(text):
    return [w for run in words(text) for w in re.findall(f"{HAN}|(?:(?!{HAN}).)+", run, re.S)]


def test_short_items_are_found_whole(spark):
    rng = random.Random(6)
    vocabulary = ["was", "ist", "Die", "Hauptstadt", "von", "\u6771", "\u4eac", "x\u6771y", "\u306f\u3044", "\U00020000"]
    items = [(i, rng.choice([" ", ", "]).join(rng.choices(vocabulary, k=n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7] * 4)]
    items += [(100, "--"), (101, ""), (102, None), (103, items[1][1]), (103, items[2][1])]
    docs = [(d, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for d in range(150)]
    docs += [(200, None), (201, items[6][1].upper() + "!"), (201, items[6][1])]
    expected = {}
    for d, text in docs:
        w = characters_or_words(text)
        for i, item in items:
            own = characters_or_words(item)
            places = [k for k in range(len(w) - len(own) + 1) if own and w[k : k + len(own)] == own]
            if places and len(own) < 8:
                expected[d, i] = min(expected.get((d, i), (9**9, 0)), (places[0], places[0] + len(own) - 1))
    df, bm = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id int, text string")
    rows = contaminated(df, bm, short=True).where("score = 1").collect()
    found = {(r["doc_id"], r["item_id"]): (r["first_word"], r["last_word"]) for r in rows}
    long = {i for i, t in items if len(characters_or_words(t)) >= 8}
    assert len(expected) > 100 and {k: v for k, v in found.items() if k[1] not in long} == expected
    kept = {r["doc_id"] for r in without_test_items(df, bm, short=True).collect()}
    assert kept == {d for d, _ in docs} - {r["doc_id"] for r in contaminated(df, bm, short=True).collect()}
    # in blocks, of which some have short items only
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(df, bm, short=True, block_bytes=40).collect()} >= expected.keys()


def test_items_without_blanks(spark):
    rng = random.Random(8)
    text = lambda n: "".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(n))
    item, short = text(50), text(5)
    copy = "".join(c if k % 9 else text(1) for k, c in enumerate(item))
    docs = [(1, text(400) + item + text(300)), (2, text(90) + copy), (3, text(700)), (4, text(40) + short + text(40)), (5, short[:4])]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    bm = spark.createDataFrame([(1, item), (2, short)], "item_id int, text string")
    found = {(r["doc_id"], r["item_id"]): r["first_word"] for r in contaminated(df, bm, short=True).collect()}
    assert found.keys() == {(1, 1), (2, 1), (4, 2)} and found[1, 1] == 400 and found[4, 2] == 40
    assert {r["doc_id"] for r in without_test_items(df, bm, short=True).collect()} == {3, 5}
