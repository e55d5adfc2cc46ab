"""Training documents that hold test items of a benchmark, exact, edited or paraphrased in part.

Runs of three words of the items are counted over all documents. Those in a few documents
are *seeds*, and of every four in a row the one in the fewest documents that has any: the
seeds of an item are rare, and cover it evenly, however common the item itself is in the
corpus. A copy without three words in a row as they were is not found. Documents are joined
with items on their seeds, and where seeds meet at about the same distance, the item is
aligned with the words around by Smith and Waterman's recurrence. Its best score, as a
share of the score of a whole copy, decides.

The seeds are broadcast. Their size is measured: a benchmark beyond ``BLOCK_BYTES`` of text
is taken in blocks of items, each against all documents.

Words are runs of letters, digits and characters beyond ASCII, with A-Z in lower case. In scripts
that are written without blanks, every character is a word.
Long items are aligned in passages of about ``PASSAGE`` words, of which the best counts.

Items of fewer than ``MIN_WORDS`` words are too short for seeds and an alignment. With ``short``,
as in the query and the pipeline, a document holds one where all its words stand in a row as they
are; a word of its own is then an item as well. Without, they are not looked for.

Defined results: NULL and empty texts hold nothing. NULL items and items without a word are not
looked for. Rows that
repeat a doc_id, and rows without one, are each looked at on their own; items that repeat
an item_id count together. Equal scores go to the passage that comes first. Texts of any
length are searched whole. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from webtally.llm.wording import NOT_LETTERS, gram_hashes, per_row, words_of
from webtally.llm.workspace import keyed_texts, ship_package, slices

SEED_WORDS = 3
SEED_EVERY = 4
# Runs in so many documents or fewer are all seeds.
RARE = 32
PASSAGE = 128
MIN_WORDS = 8
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
# Text of the items that are searched for at once.
BLOCK_BYTES = 8 << 20
# Cells of the alignments that are worked on at once.
CELLS = 1 << 20


class Passages(NamedTuple):
    """Passages of items with their words and seeds. ``gram`` is sorted; entry i is in ``passage[i]`` at word ``at[i]``.

    ``short`` has, by number of words, the sorted hashes of items that are looked for as a whole, and their passages.
    """

    item: list
    words: list[np.ndarray]
    gram: np.ndarray
    passage: np.ndarray
    at: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    def __bool__(self) -> bool:
        return len(self.gram) > 0 or len(self.short) > 0


def passages_of(items: list[tuple], short: bool = False) -> Passages:
    """Cut ``(item_id, text)`` into passages; every run of words is a seed until the corpus has been counted."""
    item, words = [], []
    whole: dict[int, list[int]] = {}
    array = pa.array([text for _, text in items], pa.string())
    for first, rows, hashes, row, _ in words_of(array, NOT_LETTERS, characters=True):
        bounds = per_row(row, rows)
        for i in range(rows):
            own = hashes[bounds[i] : bounds[i + 1]]
            if short and 0 < len(own) < MIN_WORDS:
                whole.setdefault(len(own), []).append(len(words))
                item.append(items[first + i][0])
                words.append(own)
            if len(own) >= MIN_WORDS:
                parts = np.array_split(own, max(1, round(len(own) / PASSAGE)))
                item += [items[first + i][0]] * len(parts)
                words += parts
    grams = [gram_hashes(w, SEED_WORDS) if len(w) >= MIN_WORDS else w[:0] for w in words]
    sizes = [len(g) for g in grams]
    return _sorted(
        item,
        words,
        np.concatenate([np.empty(0, np.uint64), *grams]),
        np.repeat(np.arange(len(grams)), sizes),
        np.concatenate([np.empty(0, np.int64), *map(np.arange, sizes)]),
        {n: _by_hash(np.concatenate([gram_hashes(words[i], n) for i in own]), np.array(own)) for n, own in whole.items()},
    )


def _by_hash(hashes: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((passage, hashes))
    return hashes[order], passage[order]


def _sorted(item: list, words: list, gram: np.ndarray, passage: np.ndarray, at: np.ndarray, short: dict) -> Passages:
    order = np.lexsort((at, passage, gram))
    return Passages(item, words, gram[order], passage[order], at[order], short)


def with_rare_seeds(passages: Passages, distinct: np.ndarray, n_docs: np.ndarray) -> Passages:
    """Keep the runs in ``RARE`` documents at most, and the rarest of every ``SEED_EVERY`` runs in a row.

    Runs that no document has join nothing. They are left out, and never the rarest of their
    stretch where another one occurs. Equally rare ones go in order of their hash.
    """
    count = n_docs[np.searchsorted(distinct, passages.gram)]
    places = np.where(count > 0, count, np.iinfo(np.int64).max)
    order = np.lexsort((passages.at, passages.passage))
    kept = [np.flatnonzero(count <= RARE)]
    for own in np.split(order, np.flatnonzero(np.diff(passages.passage[order])) + 1):
        rank = np.lexsort((passages.gram[own], places[own])).argsort()
        width = min(SEED_EVERY, len(own))
        windows = np.lib.stride_tricks.sliding_window_view(rank, width) if len(own) else np.empty((0, 1))
        kept.append(own[np.unique(windows.argmin(axis=1) + np.arange(len(windows)))])
    some = np.unique(np.concatenate(kept)).astype(np.int64)
    some = some[count[some] > 0]
    return passages._replace(gram=passages.gram[some], passage=passages.passage[some], at=passages.at[some])


def _grams(hashes: np.ndarray, row: np.ndarray, n: int = SEED_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words that lie in one text, and the number of their first word."""
    if len(hashes) < n:
        return hashes[:0], row[:0]
    inside = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    return gram_hashes(hashes, n)[inside], inside


def _entries(wanted: np.ndarray, grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry of the sorted ``wanted`` that is among the runs: its number, and the first word of the run."""
    lo = np.searchsorted(wanted, grams, side="left")
    n = np.searchsorted(wanted, grams, side="right") - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), np.repeat(first, n)


def count_documents(texts: DataFrame, distinct: np.ndarray) -> np.ndarray:
    """In how many documents each of the given runs occurs. Partial counts, one row per run and task."""
    shared = texts.sparkSession.sparkContext.broadcast(distinct)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        total = np.zeros(len(wanted), np.int64)
        for part in slices(batches):
            for _, _, hashes, row, _ in words_of(part.column(1), NOT_LETTERS, characters=True):
                grams, first = _grams(hashes, row)
                at = np.searchsorted(wanted, grams)
                hit = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == grams)
                pairs = np.unique(np.stack([row[first[hit]], at[hit]]), axis=1)
                total += np.bincount(pairs[1], minlength=len(wanted))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["run", "n"])

    counted = texts.mapInArrow(rows, "run bigint, n bigint").groupBy("run").agg(F.sum("n").alias("n")).toArrow()
    n_docs = np.zeros(len(distinct), np.int64)
    n_docs[counted["run"].to_numpy()] = counted["n"].to_numpy()
    return n_docs


def align(item: np.ndarray, windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of an item's words with each window: score, and last word in the window.

    One row of the recurrence at a time, for all windows; gaps to the left of a cell are a
    running maximum, as every word skipped costs the same.
    """
    width = max(map(len, windows))
    text = np.zeros((len(windows), width), np.uint64)
    real = np.zeros(text.shape, bool)
    for i, w in enumerate(windows):
        text[i, : len(w)], real[i, : len(w)] = w, True
    slope = -GAP * np.arange(width + 1, dtype=np.int32)
    above = np.zeros((len(windows), width + 1), np.int32)
    best, last = np.zeros(len(windows), np.int32), np.zeros(len(windows), np.int64)
    rows = np.arange(len(windows))
    for word in item:
        cell = np.zeros_like(above)
        same = (text == word) & real
        np.maximum(above[:, :-1] + np.where(same, MATCH, MISMATCH), above[:, 1:] + GAP, out=cell[:, 1:])
        np.maximum(cell, 0, out=cell)
        above = np.maximum.accumulate(cell + slope, axis=1) - slope
        at = above.argmax(axis=1)
        better = above[rows, at] > best
        best[better], last[better] = above[rows, at][better], at[better] - 1
    return best, last


class Found(NamedTuple):
    row: int
    passage: int
    score: float
    first: int
    last: int


def search(texts: pa.Array, passages: Passages, threshold: float) -> Iterator[Found]:
    """Passages found in each text: the words from ``first`` to ``last`` align with them."""
    if not passages:
        return
    for begin, rows, hashes, row, _ in words_of(texts, NOT_LETTERS, characters=True):
        bounds = per_row(row, rows)
        for n, (wanted, of) in passages.short.items():
            entry, word = _entries(wanted, *_grams(hashes, row, n))
            # the first place of each item in each text
            places, at = np.unique(np.stack([row[word], of[entry]]), axis=1, return_index=True)
            for r, passage, w in zip(*places.tolist(), word[at].tolist()):
                offset = w - int(bounds[r])
                yield Found(begin + r, passage, 1.0, offset, offset + n - 1)
        entry, word = _entries(passages.gram, *_grams(hashes, row))
        # the word of the block where the passage would begin, had nothing been added or left out
        origin = word - passages.at[entry]
        key = np.stack([row[word], passages.passage[entry], origin])
        for passage, spans in _regions(key, passages).items():
            item = passages.words[passage]
            slack = len(item) // 2 + 2
            windows, places = [], []
            for r, low, high in spans:
                a, b = max(int(bounds[r]), low - slack), min(int(bounds[r + 1]), high + len(item) + slack)
                windows.append(hashes[a:b])
                places.append((r, a - int(bounds[r])))
            yield from _aligned(item, passage, windows, places, begin, threshold)


def _regions(key: np.ndarray, passages: Passages) -> dict[int, list[tuple[int, int, int]]]:
    """Seeds of one passage in one text that agree in where it begins, as ``row, lowest, highest`` beginning."""
    regions: dict[int, list[tuple[int, int, int]]] = {}
    key = key[:, np.lexsort((key[2], key[1], key[0]))]
    if not key.shape[1]:
        return regions
    lengths = np.array([len(w) for w in passages.words])
    apart = (np.diff(key[0]) != 0) | (np.diff(key[1]) != 0) | (np.diff(key[2]) > lengths[key[1, 1:]] // 2)
    starts = np.concatenate([[0], np.flatnonzero(apart) + 1, [key.shape[1]]])
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        regions.setdefault(int(key[1, a]), []).append((int(key[0, a]), int(key[2, a]), int(key[2, b - 1])))
    return regions


def _aligned(
    item: np.ndarray, passage: int, windows: list[np.ndarray], places: list, begin: int, threshold: float
) -> Iterator[Found]:
    order = sorted(range(len(windows)), key=lambda i: len(windows[i]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(windows[order[to]]) <= CELLS:
            to += 1
        part = [windows[i] for i in order[at:to]]
        best, last = align(item, part)
        for j in np.flatnonzero(best >= threshold * MATCH * len(item)):
            # the first word is the last one of the same alignment read backwards
            _, back = align(item[::-1], [part[j][: last[j] + 1][::-1]])
            row, offset = places[order[at + j]]
            score = float(best[j]) / (MATCH * len(item))
            yield Found(begin + row, passage, score, int(offset + last[j] - back[0]), int(offset + last[j]))
        at = to


def prepared(
    docs: DataFrame, benchmark: DataFrame, text: str, item_key: str, item_text: str, block_bytes: int, short: bool
) -> Iterator[Passages]:
    """The benchmark's passages with their rare seeds, block by block."""
    items = benchmark.select(benchmark[f"`{item_key}`"].alias("item_id"), benchmark[f"`{item_text}`"].alias("text"))
    items = items.where("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-size // block_bytes)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))
    texts = docs.select(F.lit(0), docs[f"`{text}`"])
    for i in range(blocks):
        own = items.where(block == i).select("item_id", "text").toArrow()  # about block_bytes, as measured
        rows = sorted(zip(own["item_id"].to_pylist(), own["text"].to_pylist()), key=str)
        passages = passages_of(rows, short)
        if len(passages.gram):
            distinct = np.unique(passages.gram)
            passages = with_rare_seeds(passages, distinct, count_documents(texts, distinct))
        if passages:
            yield passages


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    short: bool = False,
) -> DataFrame:
    """Documents and the items they hold: ``doc_id, item_id, score, first_word, last_word``.

    ``score`` is 1 for a whole copy. The two numbers of words (from 0) say where it is.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = keyed_texts(docs, key, text)
    kinds = texts.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, first_word bigint, last_word bigint"
    found = spark.createDataFrame([], schema)
    item_type = pa.schema([("x", benchmark.limit(0).select(f"`{item_key}`").toArrow().schema.field(0).type)]).field(0).type
    for passages in prepared(docs, benchmark, text, item_key, item_text, block_bytes, short):
        found = found.union(texts.mapInArrow(_pairs(spark.sparkContext.broadcast(passages), threshold, item_type), schema))
    return found


def _pairs(shared, threshold: float, item_type: pa.DataType):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = shared.value
        for part in slices(batches):
            best: dict[tuple, Found] = {}
            for f in search(part.column(1), passages, threshold):
                known = best.get(at := (f.row, passages.item[f.passage]))
                if known is None or (-f.score, f.first) < (-known.score, known.first):
                    best[at] = f
            found = [best[at] for at in sorted(best, key=str)]
            yield pa.record_batch(
                [
                    part.column(0).take(pa.array([f.row for f in found], pa.int64())),
                    pa.array([passages.item[f.passage] for f in found], item_type),
                    pa.array([f.score for f in found], pa.float64()),
                    pa.array([f.first for f in found], pa.int64()),
                    pa.array([f.last for f in found], pa.int64()),
                ],
                names=["doc_id", "item_id", "score", "first_word", "last_word"],
            )

    return rows


def without_test_items(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    short: bool = False,
) -> DataFrame:
    """The documents that hold no test item, with all their columns. Nothing is shuffled."""
    ship_package(docs.sparkSession)
    clean = docs
    for passages in prepared(docs, benchmark, text, item_key, item_text, block_bytes, short):
        holds = _holds(docs.sparkSession.sparkContext.broadcast(passages), threshold)
        clean = clean.where(~holds(clean[f"`{text}`"]))
    return clean


def _holds(shared, threshold: float):
    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        found = np.zeros(len(texts), bool)
        for f in search(texts, shared.value, threshold):
            found[f.row] = True
        return pa.array(found)

    return holds
