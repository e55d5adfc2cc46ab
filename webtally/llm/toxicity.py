"""Toxicity by a chain of classifiers.

Categories are predicted one after the other. The linear model of a category sees which
words a document has and the log-odds of the categories before it. For training, those
come from models that did not see the document: each category is fitted once per fold on
the other folds, and then on all.

The words of the labelled documents are counted per category in Spark, and a model uses
the words that tell its category apart beyond chance (a log-likelihood ratio of at least
``EVIDENCE``), the ``MAX_WORDS`` strongest at most. The fit itself is small: at most
``MAX_LABELLED`` labelled documents, taken by hash of their id, with those words only. A
word that fewer than ``SHOWN`` of them have brings in up to ``SHOWN`` more that have it.
All documents are scored, on their whole texts.

Texts are never stored, and shuffled once: those of labelled documents, to count their words.
What else is looked for in texts is found where they are read.

Words are runs of letters, digits and characters beyond ASCII, with A-Z in lower case. The
beginnings of longer words count as words as well, so that a stem is known in forms that
no labelled document has.

Defined results: NULL and empty texts have no words and get the probability that says.
Rows without a doc_id are scored like others, but not learned from. Label rows that repeat
a doc_id count as positive if one of them is; those with a NULL label are left out. Where
a category has no labelled document of either kind its probability is the share of the
positive ones, 0 without any. Rows that repeat a doc_id are each scored. An empty table
gives no rows. Other columns are not read, or carried along by :func:`clean_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from webtally.llm.wording import NOT_LETTERS, per_row, words_of
from webtally.llm.workspace import keyed_texts, ship_package, slices, stored

MAX_LABELLED = 50_000
SHOWN = 20
# Bytes of the beginnings of words, which stand for all their endings.
STEMS = (4, 5, 6, 7)
MAX_WORDS = 4096
MIN_DOCS = 5
EVIDENCE = 25.0
FOLDS = 3
PENALTY = 0.1
LIMIT = 0.5
# Words of so many are worked on at a time while fitting.
BLOCK_WORDS = 1 << 17
# Log-odds fed to later models stay within these bounds.
FARTHEST = 8.0
# Bits that say which documents may have a label, and how many of them Spark's bitmaps hold each.
FILTER_BITS = 1 << 26
BITMAP_BITS = 1 << 15


class Linear(NamedTuple):
    """Weights of words and of earlier categories, and the intercept."""

    words: np.ndarray
    earlier: np.ndarray
    intercept: float


class Chain(NamedTuple):
    """Hashes of the words in use, sorted, and the models of the categories in order.

    A model has weights for all the words, 0 for those that do not tell its category apart.
    """

    hashes: np.ndarray
    models: list[Linear]


def document_words(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct words and beginnings of words of every text as sorted hashes."""
    for _, rows, hashes, row, _ in words_of(texts, NOT_LETTERS, STEMS):
        bounds = per_row(row, rows)
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield np.unique(hashes[a:b])


def _labels(labels: DataFrame, categories: Sequence[str]) -> DataFrame:
    """``doc_id, own``: the labelled ids, each once, ``own`` holding a 0 or 1 per category."""
    known = F.lit(True)
    for c in categories:
        known &= F.col(c).isNotNull()
    rows = labels.where(F.col("doc_id").isNotNull() & known)
    single = rows.groupBy("doc_id").agg(*[F.max(F.col(c).cast("int")).alias(c) for c in categories])
    return single.select("doc_id", F.array(*categories).alias("own"))


def _maybe_labelled(docs: DataFrame, own: DataFrame) -> DataFrame:
    """The documents without most of those that have no label; only a join with ``own`` tells for sure.

    Kept are those whose id has its bit among the bits of the labelled ids. These are 8 MB for any number of labels.
    """
    if docs.schema["doc_id"].dataType != own.schema["doc_id"].dataType:
        return docs  # equal ids of other types have other hashes
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FILTER_BITS))
    bitmap, bit = F.floor(place / BITMAP_BITS), (place % BITMAP_BITS).cast("int")
    placed = own.select(bitmap.alias("_bitmap"), bit.alias("_bit")).repartition("_bitmap")
    bits = placed.groupBy("_bitmap").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return docs.join(F.broadcast(bits), (F.col("_bitmap") == bitmap) & (F.getbit(byte, bit % 8) == 1), "left_semi")


def _labelled(docs: DataFrame, labels: DataFrame, categories: Sequence[str], most: int | None = None) -> DataFrame:
    """``doc_id, text, own``: the labelled documents or a sample of them."""
    own = _labels(labels, categories)
    if most is None:
        # Labels are few bytes and once per id: their partitions are hashed, and texts need no sort.
        return _maybe_labelled(docs, own).join(own.hint("shuffle_hash"), "doc_id")
    chosen = own.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(most)
    return docs.join(F.broadcast(chosen), "doc_id")  # ``most`` rows of a few bytes


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def _number(n_words: int) -> tuple[type, str]:
    """The smallest kind of number that counts the words in use, for NumPy and for Spark: all the sample's words come to the driver."""
    return (np.int16, "smallint") if n_words <= np.iinfo(np.int16).max + 1 else (np.int32, "int")


def _with_words(labelled: DataFrame, hashes: np.ndarray) -> DataFrame:
    """``doc_id, own, words, place``: numbers of the words in use instead of texts; copies of a text have one ``place``."""
    number, name = _number(len(hashes))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            used = [x.astype(number) for x in _used(part["text"], hashes)]
            words = pa.array(used, pa.list_(pa.from_numpy_dtype(number)))
            yield pa.record_batch([part["doc_id"], part["own"], words, part["place"]], names=["doc_id", "own", "words", "place"])

    placed = labelled.select("doc_id", "own", "text", F.xxhash64("text", "own").alias("place"))
    return placed.mapInArrow(rows, f"doc_id {_kind(labelled)}, own array<int>, words array<{name}>, place bigint")


def _with_rare_words(sample: DataFrame, docs: DataFrame, own: DataFrame, hashes: np.ndarray) -> DataFrame:
    """The sample, and up to ``SHOWN`` labelled documents for each word that it hardly has."""
    counts = sample.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    seen = counts.where(F.col("n") >= SHOWN).toArrow()
    rare = np.delete(hashes, seen["word"].to_numpy())
    if not len(rare):
        return sample

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            used = _used(part["text"], rare)
            row = np.repeat(np.arange(len(used)), [len(x) for x in used])
            word = np.concatenate([np.empty(0, np.int64), *used]).astype(np.int32)
            yield pa.record_batch([part["doc_id"].take(pa.array(row)), pa.array(word)], names=["doc_id", "word"])

    found = _maybe_labelled(docs, own).mapInArrow(rows, f"doc_id {_kind(docs)}, word int")
    first = Window.partitionBy("word").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id")
    shown = found.join(own, "doc_id").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= SHOWN)
    more = shown.select("doc_id", "own").distinct().join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti")
    more = stored(more, "rare-words")  # ``SHOWN`` rows of a few bytes for each word in use at most
    return sample.union(_with_words(docs.join(F.broadcast(more), "doc_id"), hashes))


def _select_words(labelled: DataFrame, n_categories: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hashes of the words that tell some category apart, and for each category which of them do."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own = np.array(part["own"].to_pylist(), np.int64).reshape(-1, n_categories)
            sets = list(document_words(part["text"]))
            words, at = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True)
            row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            counts = [np.bincount(at, own[row, c], len(words)).astype(np.int64) for c in range(n_categories)]
            yield pa.record_batch(
                {"word": pa.array(words.view(np.int64)), "n": pa.array(np.bincount(at, minlength=len(words)))}
                | {f"n{c}": pa.array(x) for c, x in enumerate(counts)}
            )

    positive = [f"n{c}" for c in range(n_categories)]
    totals = labelled.agg(F.count("*"), *[F.coalesce(F.sum(F.col("own")[c]), F.lit(0)) for c in range(n_categories)]).first()
    counted = labelled.mapInArrow(rows, "word bigint, n bigint, " + ", ".join(f"{c} bigint" for c in positive))
    counted = counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", *positive)])
    counted = stored(counted.where(F.col("n") >= MIN_DOCS), "word-counts")

    def part(k: Column, expected: Column) -> Column:
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    ratios = []
    for c, name in enumerate(positive):
        share = F.lit(totals[c + 1] / max(1, totals[0]))
        n, k, rest = F.col("n"), F.col(name), totals[c + 1] - F.col(name)
        others = totals[0] - n
        cells = ((k, n * share), (n - k, n * (1 - share)), (rest, others * share), (others - rest, others * (1 - share)))
        ratios.append(2 * sum((part(*cell) for cell in cells), F.lit(0.0)))
    chosen = []
    for ratio in ratios:
        strong = counted.select("word", ratio.alias("strength")).where(F.col("strength") >= EVIDENCE)
        best = strong.orderBy(F.desc("strength"), "word").limit(MAX_WORDS).select("word").toArrow()
        chosen.append(best["word"].to_numpy().view(np.uint64))
    hashes = np.unique(np.concatenate(chosen))
    return hashes, [np.isin(hashes, own) for own in chosen]


def _used(texts: pa.Array, hashes: np.ndarray) -> list[np.ndarray]:
    """Numbers of the words in use that each text has."""
    out = []
    for words in document_words(texts):
        at = np.searchsorted(hashes, words)
        out.append(at[hashes[np.minimum(at, len(hashes) - 1)] == words] if len(hashes) else at[:0])
    return out


class Incidence(NamedTuple):
    """Which words every document has: document ``i`` those from ``bounds[i]`` to ``bounds[i + 1]``.

    Only the words are as long as all documents together. Whatever else is made per word is made for
    a block of documents at a time.
    """

    bounds: np.ndarray
    word: np.ndarray

    def blocks(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """The documents of each block, and for each of its words the place of its document in it and the word."""
        at, n = 0, len(self.bounds) - 1
        while at < n:
            to = max(at + 1, int(np.searchsorted(self.bounds, self.bounds[at] + BLOCK_WORDS, side="right")) - 1)
            sizes = np.diff(self.bounds[at : to + 1])
            yield slice(at, to), np.repeat(np.arange(to - at), sizes), self.word[self.bounds[at] : self.bounds[to]]
            at = to

    def part(self, documents: np.ndarray, words: np.ndarray) -> Incidence:
        """The marked documents with the marked words."""
        sizes = [np.empty(0, np.int64)]
        for own, row, word in self.blocks():
            mine = documents[own]
            sizes.append(np.bincount(row[mine[row] & words[word]], minlength=len(mine))[mine])
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        kept, at = np.empty(bounds[-1], self.word.dtype), 0
        for own, row, word in self.blocks():
            some = word[documents[own][row] & words[word]]
            kept[at : at + len(some)] = some
            at += len(some)
        return Incidence(bounds, kept)


def _ordered(lists: pa.ChunkedArray, order: np.ndarray) -> Incidence:
    """The lists of words in another order. Beside them only the result is held whole."""
    chunks = [x for x in lists.chunks if len(x)]
    sizes = np.concatenate([np.empty(0, np.int64), *[np.diff(x.offsets.to_numpy()) for x in chunks]])
    bounds = np.concatenate([[0], np.cumsum(sizes[order])])
    starts = np.empty(len(order), np.int64)
    starts[order] = bounds[:-1]
    word, at = np.empty(bounds[-1], lists.type.value_type.to_pandas_dtype()), 0
    for part in chunks:
        offsets = part.offsets.to_numpy().astype(np.int64)
        n = len(part)
        shift = np.repeat(starts[at : at + n] - (offsets[:-1] - offsets[0]), sizes[at : at + n])
        word[shift + np.arange(len(shift))] = part.flatten().to_numpy()
        at += n
    return Incidence(bounds, word)


def _log_odds(model: Linear, used: Incidence, earlier: np.ndarray) -> np.ndarray:
    z = model.intercept + earlier @ model.earlier
    for own, row, word in used.blocks():
        z[own] += np.bincount(row, model.words[word], own.stop - own.start)
    return z


def fit(row: np.ndarray, word: np.ndarray, earlier: np.ndarray, y: np.ndarray, n_words: int) -> Linear:
    """:func:`fit_documents` for pairs of a document's number and a word."""
    order = np.argsort(row, kind="stable")
    used = Incidence(np.searchsorted(row[order], np.arange(len(y) + 1)), word[order].astype(np.int32))
    return fit_documents(used, earlier, y, n_words)


def fit_documents(used: Incidence, earlier: np.ndarray, y: np.ndarray, n_words: int) -> Linear:
    """Penalised logistic regression, by quasi-Newton steps with a limited memory."""
    n, m = len(y), earlier.shape[1]
    positive = y.sum()
    if positive in (0, n):
        return Linear(np.zeros(n_words), np.zeros(m), np.inf if positive else -np.inf)

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = _log_odds(Linear(x[:n_words], x[n_words:-1], x[-1]), used, earlier)
        p = 1 / (1 + np.exp(-z))
        slope = p - y
        loss = np.logaddexp(0, z).sum() - z @ y + PENALTY / 2 * (x[:-1] @ x[:-1])
        gradient = np.concatenate([np.zeros(n_words), earlier.T @ slope, [slope.sum()]])
        for own, row, word in used.blocks():
            gradient[:n_words] += np.bincount(word, slope[own][row], n_words)
        gradient[:-1] += PENALTY * x[:-1]
        return loss, gradient

    x = np.zeros(n_words + m + 1)
    x[-1] = np.log(positive / (n - positive))
    loss, gradient = value(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(200):
        q, taken = gradient.copy(), []
        for s, d in reversed(steps):
            a = (s @ q) / (s @ d)
            taken.append(a)
            q -= a * d
        if steps:
            s, d = steps[-1]
            q *= (s @ d) / (d @ d)
        else:
            q /= max(1.0, np.abs(q).max())
        for (s, d), a in zip(steps, reversed(taken)):
            q += (a - (d @ q) / (s @ d)) * s
        size, slope = 1.0, gradient @ q
        while True:
            new, (new_loss, new_gradient) = x - size * q, value(x - size * q)
            if new_loss <= loss - 1e-4 * size * slope or size < 1e-8:
                break
            size /= 2
        s, d = new - x, new_gradient - gradient
        if s @ d > 1e-12:
            steps = [*steps[-9:], (s, d)]
        done = loss - new_loss < 1e-7 * max(1.0, abs(loss))
        x, loss, gradient = new, new_loss, new_gradient
        if done:
            break
    return Linear(x[:n_words], x[n_words:-1], float(x[-1]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str],
    key: str = "doc_id",
    text: str = "text",
    most: int = MAX_LABELLED,
) -> Chain:
    """Fit the chain. ``labels`` has ``doc_id`` and a 0/1 column per category, in the order of the chain."""
    ship_package(docs.sparkSession)
    texts = keyed_texts(docs, key, text)
    hashes, told = _select_words(_labelled(texts, labels, categories), len(categories))
    sample = stored(_with_words(_labelled(texts, labels, categories, most), hashes), "sample")
    # Copies of a text are in one fold. The rows of the sample, a few numbers each, come to the driver.
    found = _with_rare_words(sample, texts, _labels(labels, categories), hashes).select("own", "words", "place").toArrow()
    place = found["place"].to_numpy()
    order = np.argsort(place, kind="stable")
    y = found["own"].combine_chunks().flatten().to_numpy().reshape(-1, len(categories))[order].astype(np.float64)
    used = _ordered(found["words"], order)
    fold = place[order] % FOLDS
    del found, place, order
    pa.default_memory_pool().release_unused()  # the driver has the rest of the job before it

    models, earlier = [], np.zeros((len(y), 0))
    for c in range(len(categories)):
        unseen = np.zeros(len(y))
        for k in range(FOLDS):
            mine = fold == k
            model = fit_documents(used.part(~mine, told[c]), earlier[~mine], y[~mine, c], len(hashes))
            unseen[mine] = _log_odds(model, used, earlier)[mine]
        everyone = np.ones(len(y), bool)
        models.append(fit_documents(used.part(everyone, told[c]), earlier, y[:, c], len(hashes)))
        earlier = np.column_stack([earlier, np.clip(unseen, -FARTHEST, FARTHEST)])
    return Chain(hashes, models)


def probabilities(texts: pa.Array, chain: Chain) -> np.ndarray:
    """Probability of every category for every text."""
    lists = _used(texts, chain.hashes)
    bounds = np.cumsum([0, *[len(x) for x in lists]])
    used = Incidence(bounds, np.concatenate([np.empty(0, np.int64), *lists]))
    earlier, out = np.zeros((len(lists), 0)), []
    for model in chain.models:
        z = np.clip(_log_odds(model, used, earlier), -700, 700)
        out.append(1 / (1 + np.exp(-z)))
        earlier = np.column_stack([earlier, np.clip(z, -FARTHEST, FARTHEST)])
    return np.column_stack(out)


def score(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str],
    key: str = "doc_id",
    text: str = "text",
    most: int = MAX_LABELLED,
) -> DataFrame:
    """``doc_id`` and the probability ``p_<category>`` of every category, for every document."""
    chain = docs.sparkSession.sparkContext.broadcast(train(docs, labels, categories, key, text, most))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            p = probabilities(part.column(1), chain.value)
            yield pa.record_batch(
                {"doc_id": part.column(0)} | {f"p_{c}": pa.array(p[:, i]) for i, c in enumerate(categories)}
            )

    texts = keyed_texts(docs, key, text)
    return texts.mapInArrow(rows, f"doc_id {_kind(texts)}, " + ", ".join(f"p_{c} double" for c in categories))


def clean_documents(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str],
    reject: str,
    limit: float = LIMIT,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The documents whose probability of ``reject`` is below ``limit``, with all their columns."""
    chain = docs.sparkSession.sparkContext.broadcast(train(docs, labels, categories, key, text))
    place = list(categories).index(reject)

    @F.arrow_udf("boolean")
    def is_clean(texts: pa.Array) -> pa.Array:
        return pa.array(probabilities(texts, chain.value)[:, place] < limit)

    return docs.where(is_clean(docs[f"`{text}`"]))
