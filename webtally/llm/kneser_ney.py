"""Log-probabilities of texts under an interpolated modified Kneser-Ney bigram model.

Tokens are the words of a text, with A-Z in lower case, and one end. Tasks count the bigrams
of their documents and send each range of hashes to the task that owns it, which adds the
counts up and writes them as a *segment*: sorted hash arrays in plain files of the shared
folder. A second exchange, of one entry per word and task, gathers what is needed of
every word: its count as a context, how many words follow it once, twice and more often, and
how many precede it. Scoring tasks look the distinct words and bigrams of a few megabytes
of text up in all segments in order of the hash, one segment at a time, memory-mapped.

A bigram's hash begins with bits of its context, so that the followers of a word are
in one segment; the words that are contexts of more than ``HOT_SHARE`` of a sample are
the exception, their bigrams are dealt over all segments.

Segments are of about ``SEGMENT_TOKENS`` training tokens: their number grows with the
corpus, their size does not. Files are written under a name of the attempt and renamed, so a
task that runs again replaces its segment by the same one.

Defined results: NULL and empty texts consist of the end. Rows without a doc_id are
scored and not learned from; rows that repeat a doc_id are learned from and scored each.
Without training tokens all probabilities are those of an unknown word. Texts of any length
are counted and scored whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from webtally.llm.wording import mixed, words_of
from webtally.llm.workspace import keyed_texts, new_folder, ship_package, slices

# The hashes of the end and of what stands before the first word.
END = np.uint64(0x656E64206F662074)
START = np.uint64(0x7374617274206F66)
# Bits of the context at the front of a bigram's hash.
CONTEXT_BITS = 20
SEGMENT_TOKENS = 2_000_000
# Text that a task counts or scores at once.
COUNTED_BYTES = 8 << 20
SCORED_BYTES = 6 << 20
HOT_SHARE = 1 / 256
HOT_SAMPLE = 2000

BIGRAM = np.dtype([("context", "<u8"), ("word", "<u8"), ("n", "<u4")])
# Per word: tokens that follow it, words that follow it once, twice and more often, words before it.
STATISTICS = ("total", "once", "twice", "more", "before")
WORD = np.dtype([("word", "<u8")] + [(name, "<u8") for name in STATISTICS])


class Tokens(NamedTuple):
    """Tokens of a block of texts: hash, the one before, and the row of the text."""

    word: np.ndarray
    before: np.ndarray
    row: np.ndarray
    rows: int


def tokens_of(texts: pa.Array) -> Iterator[Tokens]:
    """The words of every text and its end."""
    for _, rows, hashes, row, _ in words_of(texts):
        at = np.searchsorted(row, np.arange(1, rows + 1))
        word = np.insert(hashes, at, END)
        row = np.insert(row, at, np.arange(rows))
        before = np.empty_like(word)
        before[1:], before[:1] = word[:-1], START
        before[1:][row[1:] != row[:-1]] = START
        yield Tokens(word, before, row, rows)


def bigram_hash(context: np.ndarray, word: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Begins with bits of the context, unless that is a hot one."""
    whole = mixed(mixed(context) + word)
    low = np.uint64(64 - CONTEXT_BITS)
    near = ((mixed(context) >> low) << low) | (whole >> np.uint64(CONTEXT_BITS))
    return np.where(_member(hot, context), whole, near)


def _member(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    """Segments are equal ranges of the first 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int32)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def _parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Array]:
    """The text columns, in parts of so many bytes put together across batches."""
    held, size = [], 0
    for part in slices(batches):
        held.append(part.column(part.num_columns - 1))
        size += part.nbytes
        if size >= most:
            yield pa.chunked_array(held)
            held, size = [], 0
    if held:
        yield pa.chunked_array(held)


def _tokens(texts: pa.ChunkedArray) -> Tokens:
    """Tokens of all chunks, with rows numbered through."""
    parts, rows = [], 0
    for chunk in texts.chunks:
        for t in tokens_of(chunk):
            parts.append((t.word, t.before, t.row + rows))
            rows += t.rows
    if not parts:
        return Tokens(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), 0)
    return Tokens(*(np.concatenate(x) for x in zip(*parts)), rows)


def _dealt(records: np.ndarray, segment: np.ndarray) -> pa.RecordBatch:
    """One row per segment, with its records as bytes, field after field."""
    order = np.argsort(segment, kind="stable")
    records, segment = records[order], segment[order]
    first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(segment) else []
    parts = np.split(records, first[1:]) if len(segment) else []
    blobs = [b"".join(part[name].tobytes() for name in records.dtype.names) for part in parts]
    return pa.record_batch(
        [pa.array(segment[first] if len(segment) else [], pa.int32()), pa.array(blobs, pa.binary())],
        names=["segment", "records"],
    )


def _records(blob: bytes, kind: np.dtype) -> np.ndarray:
    records, at = np.empty(len(blob) // kind.itemsize, kind), 0
    for name in kind.names:
        records[name] = np.frombuffer(blob, kind[name], len(records), at)
        at += len(records) * kind[name].itemsize
    return records


def _owned(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple[int, np.ndarray]]:
    """The records of each segment of a partition, whole."""
    held: list[np.ndarray] = []
    last = None
    for batch in batches:
        for segment, blob in zip(batch["segment"].to_pylist(), batch["records"].to_pylist()):
            if held and segment != last:
                yield last, np.concatenate(held)
                held = []
            held.append(_records(blob, kind))
            last = segment
    if held:
        yield last, np.concatenate(held)


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _write(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Write arrays one after the other into a file, which appears whole or not at all."""
    store, path = _place(folder)
    store.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{os.getpid()}-{os.urandom(8).hex()}"
    with store.open_output_stream(own) as out:
        for array in arrays:
            out.write(np.ascontiguousarray(array).view(np.uint8).data if len(array) else b"")
    store.move(own, f"{path}/{name}")


def _mapped(folder: str, name: str) -> np.ndarray:
    """Bytes of a file, memory-mapped. One that is not on a file system of this machine is fetched
    into an unnamed local file first, which goes with the mapping."""
    store, path = _place(folder)
    path = f"{path}/{name}"
    info = store.get_file_info(path)
    if info.type != fs.FileType.File or not info.size:
        return np.empty(0, np.uint8)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")
    with tempfile.TemporaryFile() as local:
        with store.open_input_stream(path) as source:
            while block := source.read(8 << 20):
                local.write(block)
        local.flush()
        return np.memmap(local, np.uint8, "r")


class Model(NamedTuple):
    """Where the segments are, and the few numbers that all scoring needs."""

    folder: str
    segments: int
    hot: np.ndarray
    tokens: int
    distinct: int
    documents: int
    bigram_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    bigram_types: int
    word_rest: float

    def look_up_bigrams(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of sorted bigram hashes."""
        out = np.zeros(len(hashes), np.int64)
        bounds = np.searchsorted(segment_of(hashes, self.segments), np.arange(self.segments + 1))
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            data = _mapped(self.folder, f"bigrams-{s}")
            if not len(data):
                continue
            n = int(data[:8].view(np.uint64)[0])
            own, counts = data[8 : 8 + 8 * n].view(np.uint64), data[8 + 8 * n :]
            counts = counts.view(f"<u{len(counts) // n}")
            wanted = hashes[bounds[s] : bounds[s + 1]]
            at = np.searchsorted(own, wanted)
            hit = np.flatnonzero(at < n)
            hit = hit[own[at[hit]] == wanted[hit]]
            out[bounds[s] + hit] = counts[at[hit]]
        return out

    def look_up_words(self, words: np.ndarray) -> np.ndarray:
        """Statistics of sorted words, zeros for unknown ones."""
        out = np.zeros(len(words), WORD)
        places = mixed(words)
        order = np.argsort(places)
        bounds = np.searchsorted(segment_of(places[order], self.segments), np.arange(self.segments + 1))
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            own = _mapped(self.folder, f"words-{s}").view(WORD)
            rows = order[bounds[s] : bounds[s + 1]]
            keys = own["word"]
            at = np.searchsorted(keys, words[rows])
            hit = np.flatnonzero(at < len(own))
            hit = hit[keys[at[hit]] == words[rows[hit]]]
            out[rows[hit]] = own[at[hit]]
        return out


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more from the numbers of types counted 1 to 4 times.

    Where some of these are missing the usual estimates do not exist; then fixed ones are used.
    """
    if min(n) == 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    found = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
    return tuple(d if 0 <= d <= k else f for k, d, f in zip((1, 2, 3), found, (0.5, 1.0, 1.5)))


def _discount(count: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *discounts])[np.minimum(count, 3).astype(np.int64)]


def hot_contexts(texts: DataFrame) -> np.ndarray:
    """Words of more than ``HOT_SHARE`` of the tokens in a sample of documents by hash. They decide where
    bigrams are kept, not what is counted."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, COUNTED_BYTES):
            t = _tokens(part)
            words, n = _added(t.before, np.ones(len(t.before), np.int64))
            often = n >= len(t.before) * HOT_SHARE / 4
            yield pa.record_batch([pa.array(words[often].view(np.int64)), pa.array(n[often])], names=["word", "n"])

    total = texts.count()
    share = min(1.0, HOT_SAMPLE / max(1, total))
    sample = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30)))
    counted = sample.select("text").mapInArrow(rows, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    strong = counted.orderBy(F.desc("n"), "word").limit(2 * int(1 / HOT_SHARE)).toArrow()
    words, n = strong["word"].to_numpy().view(np.uint64), strong["n"].to_numpy()
    return np.sort(words[n >= n.sum() * HOT_SHARE]) if len(words) else words


def train(texts: DataFrame) -> Model:
    """Count ``doc_id, text`` and write the model's segments."""
    spark = texts.sparkSession
    ship_package(spark)
    folder = new_folder(spark, "bigram-model")
    hot = hot_contexts(texts)
    # A word takes a few bytes; the number of segments need not be exact.
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    segments = max(1, -(-size // (6 * SEGMENT_TOKENS)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, COUNTED_BYTES):
            t = _tokens(part)
            hashes = bigram_hash(t.before, t.word, hot)
            order = np.argsort(hashes, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(hashes[order]) != 0]))
            records = np.empty(len(first), BIGRAM)
            records["context"], records["word"] = t.before[order[first]], t.word[order[first]]
            records["n"] = np.diff(np.append(first, len(order)))
            yield _dealt(records, segment_of(hashes[order[first]], segments))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, records in _owned(batches, BIGRAM):
            hashes = bigram_hash(records["context"], records["word"], hot)
            keys, n = _added(hashes, records["n"].astype(np.int64))
            width = next(w for w in (2, 4, 8) if int(n.max()) < 1 << 8 * w)
            _write(folder, f"bigrams-{segment}", np.array([len(keys)], np.uint64), keys, n.astype(f"<u{width}"))
            order = np.argsort(hashes, kind="stable")
            one = order[np.searchsorted(hashes[order], keys)]
            context, word = records["context"][one], records["word"][one]
            words = np.unique(np.concatenate([context, word]))
            own = np.zeros(len(words), WORD)
            own["word"] = words
            at = np.searchsorted(words, context)
            own["total"] = np.bincount(at, n, len(words))
            for name, kept in (("once", n == 1), ("twice", n == 2), ("more", n > 2)):
                own[name] = np.bincount(at[kept], minlength=len(words))
            own["before"] = np.bincount(np.searchsorted(words, word), minlength=len(words))
            dealt = _dealt(own, segment_of(mixed(words), segments))
            types = [int((n == k).sum()) for k in (1, 2, 3, 4)]
            counts = pa.array([types] + [None] * (dealt.num_rows - 1), pa.list_(pa.int64()))
            yield pa.record_batch([*dealt.columns, counts], names=["segment", "records", "types"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = np.zeros(4, np.int64)

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in batch["types"].to_pylist():
                    if some:
                        types[:] += some
                yield batch

        for segment, records in _owned(noted(), WORD):
            words, at = np.unique(records["word"], return_inverse=True)
            own = np.zeros(len(words), WORD)
            own["word"] = words
            for name in STATISTICS:
                own[name] = np.bincount(at, records[name], len(words))
            _write(folder, f"words-{segment}", own)
            before = own["before"].astype(np.int64)
            token = words != START
            start = int(own["total"][~token].sum())
            found = [int((before == k).sum()) for k in (1, 2, 3, 4)]
            found += [int((before > 0).sum()), int(before.sum()), int(token.sum()), start, int(own["total"][token].sum())]
            yield pa.record_batch([pa.array([found + [0] * 4], pa.list_(pa.int64()))], names=["found"])
        yield pa.record_batch([pa.array([[0] * 9 + types.tolist()], pa.list_(pa.int64()))], names=["found"])

    def by_segment(df: DataFrame) -> DataFrame:
        return df.repartition("segment").sortWithinPartitions("segment")

    counted = by_segment(texts.select("text").mapInArrow(count, "segment int, records binary"))
    added = by_segment(counted.mapInArrow(add_up, "segment int, records binary, types array<bigint>"))
    gathered = added.mapInArrow(gather, "found array<bigint>")
    found = list(gathered.agg(*[F.coalesce(F.sum(F.col("found")[i]), F.lit(0)) for i in range(13)]).first())
    word_discounts = _discounts(found[:4])
    kinds = [found[0], found[1], max(0, found[4] - found[0] - found[1])]
    rest = sum(d * k for d, k in zip(word_discounts, kinds)) / found[5] if found[5] else 1.0
    documents = found[7]  # every text has one first word or end, which follows the start
    return Model(
        folder, segments, hot, found[8] + documents, found[6], documents, _discounts(found[9:]), word_discounts, found[5], rest
    )


class Scores(NamedTuple):
    tokens: np.ndarray
    known: np.ndarray
    base: np.ndarray
    score: np.ndarray


def score_texts(texts: pa.ChunkedArray, model: Model) -> Scores:
    """Numbers and log10-probabilities of whole texts."""
    t = _tokens(texts)
    words, at = np.unique(np.concatenate([t.word, t.before]), return_inverse=True)
    word, context = at[: len(t.word)], at[len(t.word) :]
    own = model.look_up_words(words)
    count = own["total"].astype(np.int64)
    count[words == END] = model.documents
    count[words == START] = 0

    before = own["before"].astype(np.float64)
    unseen = model.word_rest / (model.distinct + 1)
    lower = np.maximum(before - _discount(own["before"], model.word_discounts), 0) / max(1, model.bigram_types) + unseen
    total = own["total"].astype(np.float64)
    spared = sum(d * own[name] for d, name in zip(model.bigram_discounts, ("once", "twice", "more")))
    rest = np.where(total > 0, spared / np.maximum(total, 1), 1.0)

    hashes, pair = np.unique(bigram_hash(t.before, t.word, model.hot), return_inverse=True)
    n = model.look_up_bigrams(hashes)[pair]
    seen = np.maximum(n - _discount(n, model.bigram_discounts), 0) / np.maximum(total[context], 1)
    p = np.log10(seen + rest[context] * lower[word])
    base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.distinct + 1)))[word]
    sums = lambda x: np.bincount(t.row, x, t.rows)
    return Scores(np.bincount(t.row, minlength=t.rows), sums(count[word] > 0).astype(np.int64), sums(base), sums(p))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every document."""
    ship_package(docs.sparkSession)
    texts = keyed_texts(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def scored() -> pa.RecordBatch:
            ids = pa.chunked_array([x.column(0) for x in held]).combine_chunks()
            s = score_texts(pa.chunked_array([x.column(1) for x in held]), shared.value)
            perplexity = 10 ** np.minimum(-s.score / s.tokens, 300)
            columns = [s.tokens, s.known, np.full(len(ids), shared.value.tokens), s.base, s.score, perplexity]
            return pa.record_batch(
                [ids, *map(pa.array, columns)],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

        for part in slices(batches):
            held.append(part)
            size += part.nbytes
            if size >= SCORED_BYTES:
                yield scored()
                held, size = [], 0
        if any(x.num_rows for x in held):
            yield scored()

    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    return texts.mapInArrow(rows, schema)


def remainder(key: Column, divisor: int) -> Column:
    """CRC-32 of a key written as text, modulo a divisor; NULL for no key."""
    return F.crc32(key.cast("string").cast("binary")) % divisor


def score_held_out(docs: DataFrame, folds: int = 5, held_out: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from all folds but one and score every document; ``held_out`` says which were not learned from."""
    texts = keyed_texts(docs, key, text)
    fold = remainder(F.col("doc_id"), folds)
    scored = score(docs, train(texts.where(fold != held_out)), key, text)
    is_held = F.coalesce(fold == held_out, F.lit(False)).alias("held_out")
    return scored.select("doc_id", is_held, *[c for c in scored.columns if c != "doc_id"])
