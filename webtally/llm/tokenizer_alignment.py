"""Alignment of the tokens of two tokenizers over the same bytes, with counts of linked ids over the corpus.

Tokenizer A (byte-level BPE, a ``tokenizers`` file) reads a space and the text, tokenizer B (a
``sentencepiece`` model that puts a space first) the text. For each, a dictionary
leads from the byte at which a token ends to the number of tokens so far. The ends in both
dictionaries are a hash-set intersection; in order, they cut both lists of ids into
groups of the same bytes. Every A token of a group is linked with every B token of it. Links are worked out
per group from the distinct ids and how often each occurs, so a long group without a common
end costs its distinct pairs, not the product of its lengths.

Where neither tokenizer has a token that goes on past a blank after another character, both end
a token before each such blank: a text is then worked out in the parts between those blanks, and a task keeps what it
worked out for up to ``KNOWN_PARTS`` short parts, since words come again. Other texts are worked out as a whole.

How many documents hold an id pair linked is counted over the corpus. The ``MOST_COMMON`` commonest
pairs are sent to all tasks, which look them up without moving anything; the pairs of a document
that are not among them are matched by a shuffle on the pair, none of which is in many documents.
What a document's pairs add up to is put together again by a number given to each row, so rows that repeat a doc_id stay apart.

Defined results: NULL and empty texts, and texts whose tokens do not spell a space and the
text, have no tokens: zeros, and '' for the digest. The strings of special tokens are plain text.
Texts of any length are read whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from webtally.llm.workspace import keyed_texts, ship_package, slices, stored

# Fixed value: the mark that a piece has for a space.
SPACE_MARK = "▁"
# Fixed value: how byte-level BPE splits a text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

MOST_COMMON = 400_000
# Bytes of text that are encoded at a time, unless one text has more, and pairs counted before they are sent on.
BATCH_BYTES = 1 << 20
COUNTED = 1 << 20
# Groups of more links than this are worked out from their distinct ids.
SMALL_GROUP = 64
# Parts that a task keeps, none longer than PART_CHARS.
KNOWN_PARTS = 200_000
PART_CHARS = 40
# Parts that are worked out together when they are new.
LEARNED = 1000
# A blank after a character that is no white space, but for one that ends the text.
BREAK = re.compile(r" (?<=\S )(?=.)", re.DOTALL)


class Vocabularies(NamedTuple):
    """The contents of both files, which every worker loads once."""

    a: str
    b: bytes


def read_vocabularies(path_a: str, path_b: str) -> Vocabularies:
    """Read by the driver: workers need no path of their own."""
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        return Vocabularies(a.read(), b.read())


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level BPE writes for each byte: itself if printable, else one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _bytes_of(token: str, alphabet: dict[str, int]) -> bytes:
    return bytes(alphabet[c] for c in token)


def _ranked(written: dict) -> tiktoken.Encoding | None:
    """The tokenizer of a byte-level BPE file by its ranks, if its merges are in order of the ids and nothing else is done.

    It gives the same ids several times faster.
    """
    alphabet, model, split = byte_alphabet(), written["model"], written.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not plain or written.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
        return None
    special = {x["content"] for x in written.get("added_tokens", [])}
    ranks = {_bytes_of(t, alphabet): i for t, i in model["vocab"].items() if t not in special}
    merged = [_bytes_of("".join(m) if isinstance(m, list) else m.replace(" ", ""), alphabet) for m in model["merges"]]
    single = [ranks.get(bytes([b]), -1) for b in range(256)]
    ids = [ranks.get(m, -1) for m in merged]
    if min(single) < 0 or max(single) > min(ids) or ids != sorted(set(ids)) or len(ranks) != 256 + len(ids):
        return None
    return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Encoders:
    """Both tokenizers, and for each of their tokens its bytes, number of bytes and id as text."""

    def __init__(self, vocabularies: Vocabularies) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_str(vocabularies.a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        written = json.loads(vocabularies.a)
        self.ranked = _ranked(written)
        alphabet = byte_alphabet()
        special = {x["id"] for x in written.get("added_tokens", [])}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = token.encode() if i in special else _bytes_of(token, alphabet)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=vocabularies.b)
        self.bytes_b = [
            bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i)
            else self.b.id_to_piece(i).replace(SPACE_MARK, " ").encode()
            for i in range(self.b.get_piece_size())
        ]
        self.sizes_a, self.sizes_b = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        # whether no token of B goes on past a blank after another character; A's split sees to that by itself
        pieces = map(self.b.id_to_piece, range(self.b.get_piece_size()))
        self.parted = self.ranked is not None and not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        self.names_a, self.names_b = [str(i) for i in range(len(self.bytes_a))], [str(i) for i in range(len(self.bytes_b))]

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of every text by A and B, both empty where they do not spell it."""
        if self.ranked is not None:
            encoded = map(self.ranked.encode_ordinary, [" " + t for t in texts])
        else:
            encoded = (x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False))
        for text, a, b in zip(texts, encoded, self.b.encode(texts, num_threads=1)):
            want = b" " + text.encode()
            spelled = bool(text) and b"".join(map(self.bytes_a.__getitem__, a)) == want
            if spelled and b"".join(map(self.bytes_b.__getitem__, b)) == want:
                yield a, b
            else:
                yield [], []


def cuts(a: list[int], b: list[int], sizes_a: list[int], sizes_b: list[int]) -> tuple[list[int], list[int]]:
    """Where both lists of ids are cut: how many tokens of each end at the same byte, from 0 tokens on."""
    ends_a = dict(zip(accumulate(map(sizes_a.__getitem__, a)), range(1, len(a) + 1)))
    ends_b = dict(zip(accumulate(map(sizes_b.__getitem__, b)), range(1, len(b) + 1)))
    common = [*filter(ends_b.__contains__, ends_a)]  # a dictionary keeps its order, so they ascend
    return [0, *map(ends_a.__getitem__, common)], [0, *map(ends_b.__getitem__, common)]


def group_texts(a: list[str], b: list[str], at_a: list[int], at_b: list[int]) -> list[str]:
    """Each group of both lists of ids as text."""
    spans = zip(at_a, at_a[1:], at_b, at_b[1:])
    return [a[i] + "|" + b[k] if j - i == 1 == m - k else ",".join(a[i:j]) + "|" + ",".join(b[k:m]) for i, j, k, m in spans]


def written_groups(a: list[str], b: list[str], at_a: list[int], at_b: list[int]) -> str:
    """The groups of both lists of ids as text."""
    return ";".join(group_texts(a, b, at_a, at_b))


def listed_links(a: list[int], b: list[int], at_a: list[int], at_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """All links in the order of their groups, as one number each, and where each group's begin, for groups that are short."""
    from_a, from_b = np.array(at_a), np.array(at_b)
    wide = np.diff(from_b)
    starts = np.concatenate([[0], np.cumsum(np.diff(from_a) * wide)])
    group = np.repeat(np.arange(len(wide)), np.diff(starts))
    place_a, place_b = np.divmod(np.arange(starts[-1]) - starts[group], wide[group])
    ids_a, ids_b = np.array(a, np.int64) << 32, np.array(b, np.int64)
    return ids_a[from_a[group] + place_a] | ids_b[from_b[group] + place_b], starts


def links(a: list[int], b: list[int], at_a: list[int], at_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct linked id pairs, as one number each and ascending, and how often each is linked."""
    ids_a, ids_b = np.array(a, np.int64) << 32, np.array(b, np.int64)
    from_a, from_b = np.array(at_a), np.array(at_b)
    single = (np.diff(from_a) == 1) & (np.diff(from_b) == 1)
    pairs = [ids_a[from_a[:-1][single]] | ids_b[from_b[:-1][single]]]
    weights = [np.ones(len(pairs[0]), np.int64)]
    more: list[int] = []
    for g in np.flatnonzero(~single).tolist():
        xs, ys = a[at_a[g] : at_a[g + 1]], b[at_b[g] : at_b[g + 1]]
        if len(xs) * len(ys) <= SMALL_GROUP:
            more += [x << 32 | y for x in xs for y in ys]
        else:
            (x, n), (y, m) = (np.unique(np.array(z, np.int64), return_counts=True) for z in (xs, ys))
            pairs.append(((x << 32)[:, None] | y[None, :]).ravel())
            weights.append((n[:, None] * m[None, :]).ravel())
    pairs.append(np.array(more, np.int64))
    if len(pairs) == 2:  # each link counts once
        return np.unique(np.concatenate(pairs), return_counts=True)
    weights.append(np.ones(len(more), np.int64))
    found, at = np.unique(np.concatenate(pairs), return_inverse=True)
    times = np.zeros(len(found), np.int64)
    np.add.at(times, at, np.concatenate(weights))
    return found, times


class Aligned(NamedTuple):
    """What a text, or a part of one, comes to: its groups as text and its distinct linked pairs, ascending."""

    n_a: int
    n_b: int
    n_groups: int
    written: str
    pairs: np.ndarray
    times: np.ndarray


NOTHING = Aligned(0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64))


class Aligner:
    """Aligns texts, with the short parts that it has met lately at hand."""

    def __init__(self, encoders: Encoders, known_parts: int = KNOWN_PARTS) -> None:
        self.encoders, self.known_parts = encoders, known_parts
        # part -> (its links as 64-bit numbers, groups as text, n_a, n_b, n_groups); None if its tokens do not spell it
        self.known: dict[str, tuple[bytes, str, int, int, int] | None] = {}

    def _whole(self, texts: list[str]) -> Iterator[Aligned]:
        e = self.encoders
        for a, b in e.encode(texts):
            if a:
                at_a, at_b = cuts(a, b, e.sizes_a, e.sizes_b)
                written = written_groups([e.names_a[i] for i in a], [e.names_b[i] for i in b], at_a, at_b)
                yield Aligned(len(a), len(b), len(at_a) - 1, written, *links(a, b, at_a, at_b))
            else:
                yield NOTHING

    def _learn(self, parts: set[str]) -> None:
        if len(self.known) + len(parts) > self.known_parts:
            self.known.clear()
        new = [p for p in parts if p not in self.known]
        for start in range(0, len(new), LEARNED):
            some = new[start : start + LEARNED]
            if not self._learn_together(some):
                for part in some:
                    if not self._learn_together([part]):
                        self.known[part] = None

    def _learn_together(self, parts: list[str]) -> bool:
        """Work out parts as one text, unless its tokens do not spell it or do not end with each part."""
        e = self.encoders
        ((a, b),) = e.encode([" ".join(parts)])
        if not a:
            return False
        at_a, at_b = cuts(a, b, e.sizes_a, e.sizes_b)
        ends = np.cumsum([e.sizes_a[i] for i in a])[np.array(at_a[1:]) - 1]
        part_ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        last = np.searchsorted(ends, part_ends)
        if not np.array_equal(ends[last], part_ends):
            return False
        written = group_texts([e.names_a[i] for i in a], [e.names_b[i] for i in b], at_a, at_b)
        codes, starts = listed_links(a, b, at_a, at_b)
        coded, starts, first = codes.tobytes(), (starts * 8).tolist(), 0
        for part, to in zip(parts, (last + 1).tolist()):
            sizes = (at_a[to] - at_a[first], at_b[to] - at_b[first], to - first)
            self.known[part] = (coded[starts[first] : starts[to]], ";".join(written[first:to]), *sizes)
            first = to
        return True

    def _joined(self, parts: list[str]) -> Aligned | None:
        """A text from its parts, or None if the tokens of a part do not spell it."""
        found = list(map(self.known.get, parts))
        longer: list[Aligned] = []
        if None in found:
            others = [i for i, (p, f) in enumerate(zip(parts, found)) if f is None]
            if any(parts[i] in self.known for i in others):
                return None
            longer = list(self._whole([parts[i] for i in others]))
            if any(not x.n_a for x in longer):
                return None
            for i, x in zip(others, longer):
                found[i] = (b"", x.written, x.n_a, x.n_b, x.n_groups)
        coded, written, n_a, n_b, n_groups = zip(*found)
        pairs, times = np.unique(np.frombuffer(b"".join(coded), np.int64), return_counts=True)
        if longer:
            weights = np.concatenate([times, *[x.times for x in longer]])
            pairs, at = np.unique(np.concatenate([pairs, *[x.pairs for x in longer]]), return_inverse=True)
            times = np.zeros(len(pairs), np.int64)
            np.add.at(times, at, weights)
        return Aligned(sum(n_a), sum(n_b), sum(n_groups), ";".join(written), pairs, times)

    def align(self, texts: list[str]) -> Iterator[Aligned]:
        """Every text; empty ones, and those that their tokens do not spell, come to nothing."""
        if not self.encoders.parted:
            yield from self._whole(texts)
            return
        parted = [BREAK.split(t) if t and SPACE_MARK not in t else [] for t in texts]
        short = {p for parts in parted for p in parts if len(p) <= PART_CHARS and not p[-1].isspace()}
        self._learn(short)
        for text, parts in zip(texts, parted):
            aligned = self._joined(parts) if parts else None
            yield aligned if aligned is not None else next(self._whole([text]))


def _aligner(known: list[Aligner], vocabularies) -> Aligner:
    if not known:
        known.append(Aligner(Encoders(vocabularies.value)))
    return known[0]


DOCUMENT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
PAIRS = "a array<int>, b array<int>, times array<bigint>"


def linked_documents(docs: DataFrame, vocabularies: Vocabularies, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with a ``row`` number of its own, its counts and digest, and its distinct linked id pairs."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(vocabularies)
    texts = keyed_texts(docs, key, text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[Aligner] = []
        number = TaskContext.get().partitionId() << 33
        for part in slices(batches, BATCH_BYTES):
            counts, digests, ids = [], [], []
            for x in _aligner(known, shared).align([t or "" for t in part["text"].to_pylist()]):
                digests.append(hashlib.sha256(x.written.encode()).hexdigest() if x.n_a else "")
                counts.append((x.n_a, x.n_b, x.n_groups, int(x.times.sum())))
                ids.append((x.pairs >> 32, x.pairs & 0xFFFFFFFF, x.times))
            table = {"row": pa.array(range(number, number + part.num_rows), pa.int64()), "doc_id": part["doc_id"]}
            number += part.num_rows
            for i, name in enumerate(("n_a", "n_b", "n_groups", "n_links")):
                table[name] = pa.array([c[i] for c in counts], pa.int64())
            table["groups_sha256"] = pa.array(digests, pa.string())
            for i, (name, kind) in enumerate((("a", pa.int32()), ("b", pa.int32()), ("times", pa.int64()))):
                offsets = np.cumsum([0, *[len(x[i]) for x in ids]], dtype=np.int32)
                values = np.concatenate([x[i] for x in ids]).astype(kind.to_pandas_dtype())
                table[name] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
            yield pa.record_batch(table)

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(rows, f"row bigint, doc_id {kind}, {DOCUMENT}, {PAIRS}")


def _codes(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of all rows of a batch as one number each, their times and the bounds of the rows."""
    a, b, times = (part[c] for c in ("a", "b", "times"))
    bounds = a.offsets.to_numpy() - a.offsets[0].as_py()
    codes = a.flatten().to_numpy().astype(np.int64) << 32 | b.flatten().to_numpy()
    return codes, times.flatten().to_numpy(), bounds


def pair_counts(linked: DataFrame) -> DataFrame:
    """``a, pair, n, best``: in how many rows each id pair is linked, and whether no pair of its A id is in more."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        pending, waiting = [], 0

        def merge() -> None:
            nonlocal known, counts, pending, waiting
            new, n = np.unique(np.concatenate([np.empty(0, np.int64), *pending]), return_counts=True)
            both, at = np.unique(np.concatenate([known, new]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)
            known, pending, waiting = both, [], 0

        for part in slices(batches):
            pending.append(_codes(part)[0])
            waiting += len(pending[-1])
            if waiting >= COUNTED:
                merge()
                if len(known) >= 2 * COUNTED:
                    yield pa.record_batch([pa.array(known), pa.array(counts)], names=["pair", "n"])
                    known, counts = known[:0], counts[:0]
        merge()
        yield pa.record_batch([pa.array(known), pa.array(counts)], names=["pair", "n"])

    partial = linked.select("a", "b", "times").mapInArrow(rows, "pair bigint, n bigint")
    counted = partial.groupBy("pair").agg(F.sum("n").alias("n"))
    counted = stored(counted.select(F.shiftright("pair", 32).alias("a"), "pair", "n"), "pair-counts")
    # one row per id of A's vocabulary, whose size bounds it
    highest = counted.groupBy("a").agg(F.max("n").alias("most"))
    return counted.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(
    docs: DataFrame, vocabularies: Vocabularies, key: str = "doc_id", text: str = "text", most_common: int = MOST_COMMON
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    spark = docs.sparkSession
    linked = stored(linked_documents(docs, vocabularies, key, text), "linked")
    counts = stored(pair_counts(linked), "pair-best")
    common = counts.orderBy(F.desc("n"), "pair").limit(most_common).toArrow().combine_chunks().sort_by("pair")
    common = tuple(common[c].to_numpy() for c in ("pair", "n", "best"))
    sent = spark.sparkContext.broadcast(common)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for part in slices(batches):
            codes, times, bounds = _codes(part)
            at = np.minimum(np.searchsorted(pair, codes), max(0, len(pair) - 1))
            known = pair[at] == codes if len(pair) else np.zeros(len(codes), bool)
            if len(pair):
                values = (np.where(known & best[at], times, 0), np.where(known, n[at] * times, 0))
            else:
                values = (np.zeros(len(codes), np.int64),) * 2
            sums = [np.diff(np.concatenate([[0], np.cumsum(v)])[bounds]) for v in values]
            left = np.concatenate([[0], np.cumsum(~known)])[bounds].astype(np.int32)
            fields = {c: part[c] for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            fields |= {"n_best": pa.array(sums[0], pa.int64()), "count_sum": pa.array(sums[1], pa.int64())}
            fields["rare"] = pa.ListArray.from_arrays(pa.array(left), pa.array(codes[~known], pa.int64()))
            fields["times"] = pa.ListArray.from_arrays(pa.array(left), pa.array(times[~known], pa.int64()))
            yield pa.record_batch(fields)

    kind = linked.schema["doc_id"].dataType.simpleString()
    schema = f"row bigint, doc_id {kind}, {DOCUMENT}, n_best bigint, count_sum bigint, rare array<bigint>, times array<bigint>"
    looked_up = stored(linked.mapInArrow(rows, schema), "linked-common")
    rare = looked_up.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
    rare = rare.select("row", F.col("x.rare").alias("pair"), F.col("x.times").alias("times")).join(counts, "pair")
    more = rare.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("n") * F.col("times")).alias("more_count"),
    )
    return looked_up.join(more, "row", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_count", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
