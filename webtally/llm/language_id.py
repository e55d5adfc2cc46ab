"""Language of texts by a string kernel.

A text is the set of its byte n-grams up to three, in lower case: the kernel of two texts
is the number of n-grams they share, over the geometric mean of their numbers. A few
labelled texts of every language are landmarks (Nystroem's method): their kernel matrix,
whitened, gives the features, on which kernel ridge regression is solved for each language
against the rest. The scores are linear in the presence of n-grams, so the product of the
landmarks' incidence matrix with the solution is made once, and a batch of texts is scored
by one matrix product with it.

The fit uses at most about ``MAX_TRAINING`` labelled texts in all, equally many of each
language, taken by hash of their id, and ``MAX_LANDMARKS`` landmarks among them. Every text
is scored whole.

Defined results: texts that are NULL or have no letter are ``und`` with score 0; so is
every text where nothing could be learned. Equal scores go to the language that sorts
first. Rows that repeat a doc_id are each scored; rows without one are scored and not
learned from. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from webtally.llm.workspace import keyed_texts, ship_package, slices, stored

LONGEST = 3
MAX_TRAINING = 4000
MAX_LANDMARKS = 256
RIDGE = 1e-4
UNKNOWN = "und"
# Numbers below the code of the first n-gram of each length.
_FIRST = (0, 256, 256 + 65536)
_CODES = 256 + 65536 + (1 << 24)


@lru_cache(maxsize=1)
def _place() -> np.ndarray:
    """Scratch of a worker: the last place of every n-gram, to tell distinct ones without a sort."""
    return np.zeros(_CODES, np.int32)


def grams_of(text: str) -> np.ndarray:
    """Codes of the distinct n-grams of a text's bytes."""
    data = np.frombuffer(text.lower().encode(), np.uint8).astype(np.int32)
    place, found, code = _place(), [], np.zeros(len(data), np.int32)
    for n in range(1, min(LONGEST, len(data)) + 1):
        code = (code[: len(data) - n + 1] << 8) + data[n - 1 :]
        own, order = code + _FIRST[n - 1], np.arange(len(code), dtype=np.int32)
        place[own] = order
        found.append(own[place[own] == order])
    return np.concatenate(found) if found else np.empty(0, np.int32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Model(NamedTuple):
    """Languages in order, the codes of the n-grams in use, and a row of weights for each of them."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """A score per text and language, as one product of the incidence matrix with the weights."""
        out = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(texts), 64):
            present = np.zeros((len(texts[at : at + 64]), len(self.codes)), np.float32)
            size = np.ones(len(present))
            for i, text in enumerate(texts[at : at + 64]):
                grams = grams_of(text)
                size[i] = max(1, len(grams))
                present[i, self.columns(grams)] = 1
            out[at : at + 64] = (present @ self.weights) / np.sqrt(size)[:, None]
        return out

    def columns(self, grams: np.ndarray) -> np.ndarray:
        column = _columns(self.codes.tobytes())[grams]
        return column[column >= 0]


@lru_cache(maxsize=1)
def _columns(codes: bytes) -> np.ndarray:
    """Column of every possible n-gram, -1 for those not in use. One table per worker."""
    own = np.frombuffer(codes, np.int32)
    table = np.full(_CODES, -1, np.int16 if len(own) < 1 << 15 else np.int32)
    table[own] = np.arange(len(own))
    return table


def remainder(key: Column, divisor: int) -> Column:
    """CRC-32 of a key written as text, modulo a divisor; NULL for no key."""
    return F.crc32(key.cast("string").cast("binary")) % divisor


def _sample(texts: DataFrame) -> DataFrame:
    """``language, text, landmark``: as many labelled texts of each language as the bounds allow."""
    ids = texts.select("doc_id", "language")
    counts = ids.groupBy("language").agg(F.count("*").alias("n"))
    languages = counts.agg(F.count("*")).scalar()
    # a number from 0 to that of all texts, had all languages as many as this one
    rank = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30)) / (1 << 30) * F.col("n") * languages
    own = ids.join(counts, "language").withColumn("rank", rank)
    chosen = own.where(F.col("rank") < MAX_TRAINING).select(
        "doc_id", (F.col("rank") < MAX_LANDMARKS).alias("landmark")
    )
    # about MAX_TRAINING rows, by the counts above
    return texts.join(F.broadcast(chosen.dropDuplicates(["doc_id"])), "doc_id").select("language", "text", "landmark")


def train(labelled: DataFrame) -> Model:
    """Fit a model on ``doc_id, language, text`` with neither of them NULL."""
    ship_package(labelled.sparkSession)
    sample = stored(_sample(labelled), "language-sample")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [(x, grams_of(t)) for x, t in zip(part["language"].to_pylist(), part["text"].to_pylist()) if has_letter(t)]
            yield pa.record_batch(
                [pa.array([x for x, _ in rows], pa.string()), pa.array([g for _, g in rows], pa.list_(pa.int32()))],
                names=["language", "grams"],
            )

    landmarks = sample.where("landmark").select("language", "text").mapInArrow(sets, "language string, grams array<int>")
    rows = sorted((np.sort(g).tolist(), x) for x, g in landmarks.toPandas().itertuples(index=False))
    codes = np.unique(np.concatenate([np.empty(0, np.int32), *[np.array(g, np.int32) for g, _ in rows]]))
    incidence = np.zeros((len(codes), len(rows)))
    for i, (grams, _) in enumerate(rows):
        incidence[np.searchsorted(codes, grams), i] = 1 / np.sqrt(len(grams))
    blank = Model([], codes.astype(np.int32), np.zeros((len(codes), 0)))
    if not rows:
        return blank
    kernel = Model([str(i) for i in range(len(rows))], codes.astype(np.int32), incidence)
    shared = labelled.sparkSession.sparkContext.broadcast(kernel)  # MAX_LANDMARKS columns

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [(x, t) for x, t in zip(part["language"].to_pylist(), part["text"].to_pylist()) if has_letter(t)]
            values = shared.value.scores([t for _, t in rows])
            yield pa.record_batch(
                [pa.array([x for x, _ in rows], pa.string()), pa.array(list(values), pa.list_(pa.float64()))],
                names=["language", "kernel"],
            )

    fitted = sample.select("language", "text").mapInArrow(kernels, "language string, kernel array<double>").toPandas()
    order = np.lexsort((fitted["kernel"].map(sum), fitted["language"]))
    fitted = fitted.iloc[order]  # about MAX_TRAINING rows
    languages = sorted(set(fitted["language"]))
    near = np.stack(fitted["kernel"].to_list())
    y = (fitted["language"].to_numpy()[:, None] == np.array(languages, object)).astype(float)

    among = incidence.T @ incidence
    value, vector = np.linalg.eigh(among)
    some = value > 1e-8 * value.max()
    whiten = vector[:, some] / np.sqrt(value[some])
    features = near @ whiten
    solution = np.linalg.solve(features.T @ features + RIDGE * len(near) * np.eye(features.shape[1]), features.T @ y)
    return Model(languages, codes.astype(np.int32), (incidence @ (whiten @ solution)).astype(np.float32))


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``: the best language of every text, and its score cut to 0 to 1."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array(own.languages, object)
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            known = [i for i, t in enumerate(texts) if len(names) and has_letter(t)]
            language = np.full(len(texts), UNKNOWN, object)
            score = np.zeros(len(texts))
            if known:
                scores = own.scores([texts[i] for i in known])
                best = scores.argmax(axis=1)
                language[known] = names[best]
                score[known] = np.clip(scores[np.arange(len(known)), best], 0, 1)
            yield pa.record_batch(
                [part.column(0), pa.array(language, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"]
            )

    texts = keyed_texts(docs, key, text)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(rows, f"doc_id {kind}, lang_pred string, score double")


def identify_held_out(
    docs: DataFrame, folds: int = 4, held_out: int = 2, key: str = "doc_id", text: str = "text", language: str = "lang"
) -> DataFrame:
    """Learn from all folds but one, and predict every document: ``doc_id, held_out, lang_pred, score``."""
    texts = docs.select(
        docs[f"`{key}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"), docs[f"`{language}`"].alias("language")
    )
    labelled = texts.where(
        (remainder(F.col("doc_id"), folds) != held_out) & F.col("language").isNotNull() & F.col("text").isNotNull()
    )
    found = identify(docs, train(labelled), key, text)
    is_held = F.coalesce(remainder(F.col("doc_id"), folds) == held_out, F.lit(False))
    return found.select("doc_id", is_held.alias("held_out"), "lang_pred", "score")
