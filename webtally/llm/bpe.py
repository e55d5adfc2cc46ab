"""Byte-level BPE encoding and decoding, exact, by dynamic programming over prefixes.

The last token of the encoding of a prefix is unique. It is found among the vocabulary
entries that end at the prefix's end (an automaton reports them) as the one that may
follow the last token of the prefix before it. Whether two tokens may stand side by
side is decided from their merge trees alone: no merge across their boundary may come
before the merges that formed them. Following the last tokens back from the end gives
the ids, in time linear in the text.

Defined results: NULL and empty texts have no tokens and decode to the empty text.
Texts of any length are encoded whole. Rows are independent: repeated rows and ties
give equal results, an empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from webtally.llm.workspace import keyed_texts, ship_package, slices

# Fixed value: how byte-level BPE splits text before merging.
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# The same split for texts below U+0250, with the classes written out: three times as fast.
BEYOND = re.compile("[ɐ-\U0010ffff]")
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t-\r \x85\xa0"
SPLIT_LATIN = re.compile(
    f" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+"
    f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)

# Encodings of short pieces and pair tests are remembered, up to so many of each.
REMEMBERED_PIECES = 150_000
REMEMBERED_PAIRS = 1 << 21
# Bytes of text encoded at once; the pieces of a part are Python strings, many times as large.
PART_BYTES = 1 << 20
# Pieces up to so many bytes are encoded many at a time.
LONGEST_AT_ONCE = 48


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Numbering(dict):
    """Numbers its keys in the order they are first asked for."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class SuffixAutomaton:
    """Reports, byte by byte, the longest vocabulary entry that ends there.

    ``step[row[node], byte]`` is the next node; a node that no entry goes on from shares
    the row of the node it falls back to. ``longest[node]`` is the longest entry that
    ends at a node, ``shorter[token]`` the next one that is a suffix of an entry; -1
    stands for none.
    """

    def __init__(self, entries: dict[bytes, int], size: int) -> None:
        children: list[dict[int, int]] = [{}]
        levels: list[list[tuple[int, int, int]]] = []
        ends: dict[int, int] = {}
        for value, token in entries.items():
            node = 0
            for depth, byte in enumerate(value):
                following = children[node].get(byte)
                if following is None:
                    following = children[node][byte] = len(children)
                    children.append({})
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append((node, byte, following))
                node = following
            ends[node] = token

        inner = np.fromiter(map(bool, children), bool, len(children))
        inner[0] = True
        self.row = (np.cumsum(inner) - 1).astype(np.int32)
        self.step = np.zeros((int(inner.sum()), 256), np.int32)
        self.longest = np.full(len(children), -1, np.int32)
        self.shorter = np.full(size, -1, np.int32)
        own = np.full(len(children), -1, np.int32)
        own[list(ends)] = list(ends.values())
        for depth, level in enumerate(levels):
            parent, byte, node = np.array(level).T
            # where the text without its first byte leads, which is a node one level up or higher
            fallback = self.step[self.row[parent], byte] if depth else np.zeros(len(node), np.int32)
            self.step[self.row[parent], byte] = node
            goes_on = inner[node]
            self.step[self.row[node[goes_on]]] = self.step[self.row[fallback[goes_on]]]
            self.row[node[~goes_on]] = self.row[fallback[~goes_on]]
            below = self.longest[fallback]
            self.longest[node] = np.where(own[node] >= 0, own[node], below)
            is_entry = own[node] >= 0
            self.shorter[own[node][is_entry]] = below[is_entry]


class Edges:
    """The nodes on one edge of every token's merge tree, each with the rank of the merge that ends it."""

    def __init__(self, rank: dict[tuple[int, int], int], parts: dict[int, tuple[int, int]], side: int, size: int) -> None:
        never = len(rank)
        first, tokens, ends = [0], array("i"), array("i")
        for token in range(size):
            ended = never
            while True:
                tokens.append(token)
                ends.append(ended)
                if token not in parts:
                    break
                ended, token = rank[parts[token]], parts[token][side]
            first.append(len(tokens))
        self.first, self.tokens, self.ends = array("i", first), tokens, ends

    def nodes(self, token: int) -> list[tuple[int, int]]:
        own = slice(self.first[token], self.first[token + 1])
        return list(zip(self.tokens[own], self.ends[own]))


class BytePairCodec:
    """Encoder and decoder for a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = _byte_alphabet()
        as_bytes = lambda shown: bytes(alphabet[c] for c in shown)
        self.ids = {as_bytes(shown): i for shown, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile(
            "(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")"
        )

        size = max([*self.ids.values(), *self.special.values()]) + 1
        contents = [b""] * size
        for value, i in [*self.ids.items(), *((s.encode(), i) for s, i in self.special.items())]:
            contents[i] = value
        self.contents = Strings(contents)
        self.decimals = Strings([b"%d," % i for i in range(size)])

        # rank of the merge of two tokens, and per token the two it was merged from
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int]] = {}
        for order, merge in enumerate(spec["model"]["merges"]):
            left, right = (self.ids[as_bytes(x)] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            self.rank[left, right] = order
            parts.setdefault(self.ids[contents[left] + contents[right]], (left, right))
        self.right_edge = Edges(self.rank, parts, 1, size)
        self.left_edge = Edges(self.rank, parts, 0, size)

        self.automaton = SuffixAutomaton(self.ids, size)
        self.length = self.contents.length.astype(np.int32)
        self._pair_key = np.full(REMEMBERED_PAIRS, -1, np.int64)
        self._pair_fits = np.zeros(REMEMBERED_PAIRS, bool)
        self._forget()

    def _forget(self) -> None:
        self._pieces = Numbering()
        self._start, self._count, self._flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' text is these two tokens.

        A pair on the boundary merges at its rank if both its nodes are still there: the
        left one's own merge lies further left and comes first among equal ranks, the
        right one's comes later.
        """
        right_nodes = self.left_edge.nodes(right)
        for a, a_ended in self.right_edge.nodes(left):
            for b, b_ended in right_nodes:
                rank = self.rank.get((a, b))
                if rank is not None and rank < a_ended and rank <= b_ended:
                    return False
        return True

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """:meth:`may_follow` of many pairs; a left of -1 is the start of a piece."""
        key = left.astype(np.int64) << 32 | right
        slot = (key * -7046029254386353131 >> 43) & (REMEMBERED_PAIRS - 1)
        unknown = np.flatnonzero((self._pair_key[slot] != key) & (left >= 0))
        fits = self._pair_fits[slot] | (left < 0)
        if len(unknown):
            pairs, back = np.unique(key[unknown], return_inverse=True)
            found = np.array([self.may_follow(p >> 32, p & 0xFFFFFFFF) for p in pairs.tolist()])
            fits[unknown] = found[back]
            self._pair_key[slot[unknown]] = key[unknown]
            # two new pairs may share a slot: the value must be that of the key that stayed
            stayed = self._pair_key[slot[unknown]] == key[unknown]
            self._pair_fits[slot[unknown[stayed]]] = fits[unknown[stayed]]
        return fits

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces, none empty: all ids in one array, and their number per piece.

        Works on all pieces at once, one byte position after the other, the longest
        pieces first so that those still going are in front.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-sizes, kind="stable")
        sorted_sizes = sizes[order]
        text = np.frombuffer(b"".join(pieces), np.uint8)
        starts = (np.cumsum(sizes) - sizes)[order]
        longest = int(sorted_sizes[0])
        going = np.searchsorted(-sorted_sizes, -np.arange(longest), side="left")

        auto, length = self.automaton, self.length
        last = np.full((longest + 1, len(pieces)), -1, np.int32)  # token that ends each prefix
        node = np.zeros(len(pieces), np.int32)
        for i in range(longest):
            m = going[i]
            node = auto.step[auto.row[node[:m]], text[starts[:m] + i]]
            token = auto.longest[node]
            open_ = np.arange(m)
            while len(open_):
                candidate = token[open_]
                fits = self._fits(last[i + 1 - length[candidate], open_], candidate)
                last[i + 1, open_[fits]] = candidate[fits]
                open_ = open_[~fits]
                token[open_] = auto.shorter[token[open_]]

        # back from the end of every piece; ids come out last first
        at, rows, steps = sorted_sizes.copy(), np.arange(len(pieces)), []
        while len(rows):
            token = last[at[rows], rows]
            steps.append((rows, token))
            at[rows] -= length[token]
            rows = rows[at[rows] > 0]
        counts = np.zeros(len(pieces), np.int64)
        for rows, _ in steps:
            counts[rows] += 1
        by_piece = np.empty(len(pieces), np.int64)
        by_piece[order] = counts
        first = (np.cumsum(by_piece) - by_piece)[order]
        ids = np.empty(int(counts.sum()), np.int32)
        for back, (rows, token) in enumerate(steps):
            ids[first[rows] + counts[rows] - 1 - back] = token
        return ids, by_piece

    def _encode_long(self, piece: bytes) -> np.ndarray:
        """Ids of one piece of any length; the same recurrence, byte by byte."""
        auto, length, last, node = self.automaton, self.length, [-1] * (len(piece) + 1), 0
        for end, byte in enumerate(piece, 1):
            node = auto.step[auto.row[node], byte]
            token = int(auto.longest[node])
            while not ((left := last[end - length[token]]) < 0 or self._follows(left, token)):
                token = int(auto.shorter[token])
            last[end] = token
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= int(length[last[at]])
        return np.array(ids[::-1], np.int32)

    @lru_cache(maxsize=100_000)  # noqa: B019 - one codec per worker, which lives as long
    def _follows(self, left: int, right: int) -> bool:
        return self.may_follow(left, right)

    def _places(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Where the encodings of the pieces of each text are kept, after encoding the new ones."""
        if len(self._pieces) > REMEMBERED_PIECES:
            self._forget()
        places = [np.fromiter(map(self._pieces.__getitem__, pieces), np.int64, len(pieces)) for pieces in texts]
        if len(self._pieces) > len(self._count):
            contents = [p.encode() for p in islice(self._pieces, len(self._count), None)]
            sizes = np.fromiter(map(len, contents), np.int64, len(contents))
            short, long = np.flatnonzero(sizes <= LONGEST_AT_ONCE), np.flatnonzero(sizes > LONGEST_AT_ONCE)
            ids, counts = self.encode_pieces([contents[i] for i in short]) if len(short) else ([], [])
            one_by_one = [self._encode_long(contents[i]) for i in long]
            count = np.zeros(len(contents), np.int64)
            count[short], count[long] = counts, [len(x) for x in one_by_one]
            start = np.empty(len(contents), np.int64)
            in_order = np.concatenate([short, long])
            start[in_order] = len(self._flat) + np.cumsum(count[in_order]) - count[in_order]
            self._start, self._count = np.append(self._start, start), np.append(self._count, count)
            self._flat = np.concatenate([self._flat, np.asarray(ids, np.int32), *one_by_one])
        return places

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts. Special tokens written in a text stand for themselves."""
        parts: list[tuple[int, str | int]] = []
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                split = self.special_split.split(text)
                parts += [(i, self.special[x] if k % 2 else x) for k, x in enumerate(split)]
            else:
                parts.append((i, text))
        plain = [x for _, x in parts if isinstance(x, str)]
        split = [(SPLIT if BEYOND.search(x) else SPLIT_LATIN).findall(x) for x in plain]
        encoded = (
            self._flat[_ranges(self._start[at], self._count[at])] for at in self._places(split)
        )
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for i, part in parts:
            out[i].append(next(encoded) if isinstance(part, str) else np.array([part], np.int32))
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: np.ndarray) -> str:
        """Text of a sequence of ids; bytes that are not UTF-8 become replacement characters."""
        return self.contents.joined(np.asarray(ids, np.int64)).decode("utf-8", "replace")

    def written(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self.decimals.joined(ids)[:-1]


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, one range after the other."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


class Strings:
    """Byte strings by number, joined without a Python object for each."""

    def __init__(self, strings: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.length = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.cumsum(self.length) - self.length

    def joined(self, numbers: np.ndarray) -> bytes:
        return self.data[_ranges(self.start[numbers], self.length[numbers])].tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> BytePairCodec:
    """One codec per vocabulary and worker."""
    return BytePairCodec(path)


def _encoded(own: BytePairCodec, texts: pa.Array) -> list[np.ndarray]:
    return own.encode_batch([t or "" for t in texts.to_pylist()])


def _key_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every text: ``doc_id, ids``. ``vocabulary`` is a path that every worker can open."""
    ship_package(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for part in slices(batches, PART_BYTES):
            yield pa.record_batch([part.column(0), _lists(_encoded(own, part.column(1)))], names=["doc_id", "ids"])

    texts = keyed_texts(docs, key, text)
    return texts.mapInArrow(rows, f"doc_id {_key_type(texts)}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Text of every sequence of ids: ``doc_id, text``. A NULL sequence gives the empty text."""
    ship_package(encoded.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for part in slices(batches, PART_BYTES):
            texts = [own.decode(np.array(x or [], np.int64)) for x in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    lists = keyed_texts(encoded, key, ids)
    return lists.mapInArrow(rows, f"doc_id {_key_type(lists)}, text string")


def round_trip(
    docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """Encode every text and decode its ids, in one pass: digests of both, and the ids if asked for.

    Columns ``doc_id, n_tokens, ids_sha256`` (of the decimal ids joined by commas),
    ``decoded_sha256`` (of the decoded text in UTF-8).
    """
    ship_package(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for part in slices(batches, PART_BYTES):
            ids = _encoded(own, part.column(1))
            columns = {
                "doc_id": part.column(0),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": pa.array([_sha256(own.written(x)) for x in ids]),
                "decoded_sha256": pa.array([_sha256(own.decode(x).encode()) for x in ids]),
            }
            if with_ids:
                columns["ids"] = _lists(ids)
            yield pa.record_batch(columns)

    texts = keyed_texts(docs, key, text)
    schema = f"doc_id {_key_type(texts)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return texts.mapInArrow(rows, schema + (", ids array<int>" if with_ids else ""))


def _sha256(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays), pa.int32()))
