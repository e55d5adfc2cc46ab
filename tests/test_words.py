import random
import re
from collections import Counter, defaultdict

import pytest

from webtally.operators import words as wd


def _texts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocabulary = (
        "cat cats Cat CATS CATs class classes glass s S is iS it's dog's dogs Dog "
        "12 12's 1990s _x ünï a'b the The 'quoted' bus"
    ).split()
    made = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 40))) for _ in range(400)]
    return made + ["", "  \n", None, "word, word. word-word", "x" * 50]


def test_token_counts(spark, texts):
    want = Counter(w for t in texts if t is not None for w in t.split())
    got = {r.corpus: r.countv for r in wd.token_counts(_texts(spark, texts)).collect()}
    assert got == want
    ranked = sorted(want.items(), key=lambda item: (-item[1], item[0]))
    assert [tuple(r) for r in wd.top_tokens(_texts(spark, texts), 7).collect()] == ranked[:7]


def test_ties_by_first_seen(spark):
    texts = ["", "z y", "y z x", "w x w"]
    want = Counter(w for t in texts for w in t.split()).most_common(3)
    assert [tuple(r) for r in wd.top_tokens_first_seen(_texts(spark, texts), "id", 3).collect()] == want
    assert [r.corpus for r in wd.top_tokens(_texts(spark, texts), 3).collect()] == ["w", "x", "y"]


@pytest.mark.parametrize("n", [1, 3, 7, 1000])
def test_ties_by_first_seen_with_string_keys(spark, texts, n):
    keyed = [(f"{i:04d}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(keyed, "`id` string, text string").repartition(3)
    want = Counter(w for t in texts if t is not None for w in t.split()).most_common(n)
    assert [tuple(r) for r in wd.top_tokens_first_seen(df, "id", n).collect()] == want


def test_first_tokens_skip_blank_texts(spark):
    texts = ["", None, " \n", "a", "", "b c", "", "d e f g"]
    got = wd.tokens_head(_texts(spark, texts), "id", 5).collect()
    assert [tuple(r) for r in got] == [(3, 0, "a"), (5, 0, "b"), (5, 1, "c"), (7, 0, "d"), (7, 1, "e")]
    assert wd.tokens_head(_texts(spark, ["", None]), "id").count() == 0


def test_lengths(spark, texts):
    want = Counter(len(t.split()) for t in texts if t is not None)
    hist = wd.word_count_hist(_texts(spark, texts))
    assert {r.n_words: r.n_rows for r in hist.collect()} == want
    labels = [r.words for r in wd.labelled_hist(hist).collect()]
    assert labels == sorted(f"{n} words:" for n in want)
    assert labels.index("10 words:") < labels.index("2 words:")
    stats = wd.word_count_stats(hist).first()
    assert stats.mean_rows_per_length == sum(want.values()) / len(want)
    assert stats.avg_words_per_row == sum(n * rows for n, rows in want.items()) / sum(want.values())


def _plain_term_weights(texts, stop_words, max_words):
    """The published rules of the word cloud, word by word in plain Python."""
    spellings = defaultdict(Counter)
    for text in texts:
        for word in re.findall(r"\w[\w']*", text or ""):
            word = re.sub(r"'[sS]$", "", word)
            if not word.isdigit() and word.lower() not in stop_words:
                spellings[word.lower()][word] += 1
    for plural in [k for k in spellings if k.endswith("s") and not k.endswith("ss")]:
        if plural[:-1] in spellings:
            for word, n in spellings.pop(plural).items():
                spellings[plural[:-1]][word[:-1]] += n
    rows = []
    for term, words in spellings.items():
        shown = min(words, key=lambda w: (-words[w], w))
        rows.append((term, shown, sum(words.values())))
    rows = sorted(rows, key=lambda row: (-row[2], row[0]))[:max_words]
    return [(*row, row[2] / rows[0][2]) for row in rows]


@pytest.mark.parametrize("stop_words", [(), ("the", "CAT")])
@pytest.mark.parametrize("max_words", [5, 2000])
def test_term_weights(spark, texts, stop_words, max_words):
    want = _plain_term_weights(texts, {w.lower() for w in stop_words}, max_words)
    got = [tuple(r) for r in wd.term_weights(_texts(spark, texts), max_words, stop_words).collect()]
    assert sorted(got) == sorted(want)
