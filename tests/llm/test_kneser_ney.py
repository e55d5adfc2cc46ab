import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from webtally.llm import kneser_ney, queries
from webtally.llm.kneser_ney import score, score_held_out, train

BLANKS = " \t\n\x0b\x0c\r"


def tokens(text):
    text = text or ""
    for c in BLANKS:
        text = text.replace(c, " ")
    return [w.encode().lower() for w in text.split(" ") if w] + ["end"]


def discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    if min(n) == 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return [x if 0 <= x <= k else f for k, x, f in zip((1, 2, 3), d, (0.5, 1.0, 1.5))]


class Brute:
    """The same model from its textbook definition, with dictionaries."""

    def __init__(self, texts):
        self.bigrams, self.count = Counter(), Counter()
        for text in texts:
            t = tokens(text)
            self.count.update(t)
            self.bigrams.update(zip(["start", *t[:-1]], t))
        self.follow, self.before = defaultdict(list), Counter()
        for (a, b), n in self.bigrams.items():
            self.follow[a].append(n)
            self.before[b] += 1
        self.d2, self.d1 = discounts(self.bigrams.values()), discounts(self.before.values())
        self.total = sum(self.count.values())
        self.types = sum(self.before.values())
        self.rest = sum(self.cut(self.d1, c) for c in self.before.values()) / self.types if self.types else 1.0
        self.totals = {a: (sum(n), sum(self.cut(self.d2, c) for c in n)) for a, n in self.follow.items()}

    @staticmethod
    def cut(d, c):
        return d[min(c, 3) - 1] if c else 0

    def word(self, w):
        n = self.before[w]
        return max(n - self.cut(self.d1, n), 0) / max(1, self.types) + self.rest / (len(self.count) + 1)

    def pair(self, a, b):
        if a not in self.follow:
            return self.word(b)
        n, (total, rest) = self.bigrams[a, b], self.totals[a]
        return max(n - self.cut(self.d2, n), 0) / total + rest / total * self.word(b)

    def row(self, text):
        t = tokens(text)
        base = sum(math.log10((self.count[w] + 0.5) / (self.total + 0.5 * (len(self.count) + 1))) for w in t)
        p = sum(math.log10(self.pair(a, b)) for a, b in zip(["start", *t[:-1]], t))
        return len(t), sum(self.count[w] > 0 for w in t), self.total, base, p


def check(rows, docs, learned):
    brute = Brute(learned)
    own = defaultdict(list)
    for i, text in docs:
        own[i].append(brute.row(text))
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]))
    assert own.keys() == got.keys()
    for i in own:
        for a, b in zip(sorted(own[i]), sorted(got[i]), strict=True):
            assert a[:3] == b[:3] and b[3:] == pytest.approx(a[3:], rel=1e-9), i


def learned(docs):
    return [t for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = queries.op7_kneser_ney(spark, folder).collect()
    check(rows, docs, learned(docs))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_many_segments_and_hot_contexts(spark, monkeypatch, seed):
    monkeypatch.setattr(kneser_ney, "SEGMENT_TOKENS", 300)
    rng = random.Random(seed)
    docs = [
        (i, " ".join(rng.choices(["the", "The", "of", f"w{rng.randrange(300)}", f"v{rng.randrange(20)}"], k=rng.randrange(60))))
        for i in range(300)
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)
    model = train(df.where("doc_id % 2 = 0"))
    assert model.segments > 5 and len(model.hot) >= 2
    check(score(df, model).collect(), docs, [t for i, t in docs if i % 2 == 0])


def test_probabilities_add_up_to_one(spark):
    docs = [(i, t) for i, t in enumerate(["a b c", "a b d", "b c a a", "c", "a b c d a b"] * 3)]
    brute = Brute([t for _, t in docs])
    vocabulary = list(brute.count)
    for context in ["start", *vocabulary[:-1], "new"]:
        assert sum(brute.pair(context, w) for w in [*vocabulary, "unknown"]) == pytest.approx(1)
    rows = score(spark.createDataFrame(docs, "doc_id int, text string"), train(spark.createDataFrame(docs, "doc_id int, text string"))).collect()
    check(rows, docs, [t for _, t in docs])


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, " \n\t"), (None, "a b"), (4, "a b a b"), (4, "a b a b"), (4, "c"), (5, "É é A a"),
            (6, "a " * 300_000), (7, "x" * 500_000), (8, "end start")]
    df = spark.createDataFrame([(*d, 1.0, 2) for d in docs], "doc_id bigint, text string, score double, n_tokens int")
    check(score_held_out(df).collect(), docs, learned(docs))
    assert score_held_out(df.limit(0)).count() == 0
    nothing = score(df, train(df.where("doc_id IS NULL AND doc_id = 1").select("doc_id", "text"))).collect()
    check(nothing, docs, [])


def test_texts_like_the_training_are_more_probable(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    follow = {w: rng.sample(words, 3) for w in words}

    def chain(n):
        w = [rng.choice(words)]
        while len(w) < n:
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(w)

    train_docs = spark.createDataFrame([(i, chain(100)) for i in range(100)], "doc_id int, text string")
    test = spark.createDataFrame([(0, chain(200)), (1, " ".join(rng.choices(words, k=200)))], "doc_id int, text string")
    p = {r["doc_id"]: r for r in score(test, train(train_docs)).collect()}
    assert p[0]["perplexity"] < 5 < 20 < p[1]["perplexity"]
    assert p[0]["score"] > p[0]["base_score"]


def test_segments_are_written_whole_and_again_the_same(tmp_path):
    for _ in range(2):
        kneser_ney._write(f"file://{tmp_path}/m", "s", np.arange(5, dtype=np.uint64), np.arange(5, dtype=np.uint32))
    assert [p.name for p in (tmp_path / "m").iterdir()] == ["s"]
    data = kneser_ney._mapped(f"{tmp_path}/m", "s")
    assert data[:40].view(np.uint64).tolist() == data[40:].view(np.uint32).tolist() == list(range(5))
    assert len(kneser_ney._mapped(str(tmp_path), "none")) == 0
