"""Personal data: fixed forms, and more of it found by its contexts.

E-mail and IP addresses, card and phone numbers are found by their form. They are seeds: the
two words (or marks) before them, however far, are their *contexts*. Spark scores the graph of contexts
and instances in rounds. A context's confidence for a kind is the share of its distinct
instances that are known to be of the kind, if enough of them are; an unseen identifier's
is that of its contexts taken together (one minus the product of their doubts). What
reaches ``ACCEPT`` counts as known in the next round, so that it can speak for contexts of
its own. Rounds go on until no instance is added and confidences stand still to ``STILL``. In the end every occurrence of an accepted identifier in an accepted context is a
span of the kind ``<kind>_context``. The spans of the fixed forms always stay.

An identifier is a run of letters, digits and ``+._@-`` of five characters or more with a
digit in it, outside the spans found by form. Copies of a text, and repeats of an
instance in a context, count once.

Defined results: NULL and empty texts have no spans. Texts of any length are searched whole,
in time linear in their length. Rows that repeat a doc_id, and rows without one, each
get the spans of their text. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from webtally.functions import text_digest
from webtally.llm.workspace import keyed_texts, ship_package, slices, stored

# The kinds found by form, in the order of spans that start together.
KINDS = ("email", "ip", "card", "phone")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGITS = re.compile("[0-9]+")
IDENTIFIER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+._@-")
SHORTEST_IDENTIFIER = 5
CONTEXT = re.compile(r"[^\W\d_]+|[^\w\s]")
# Characters that are read at once before a value, and the longest word that stands in a context as it is, not as its digest.
LOOK = 48

MIN_KNOWN = 5
ACCEPT = 0.8
# Share of the sum of all confidences by which it grows in the last round at most.
STILL = 1e-6
# Copies of a text that are given their spans together: a share of all documents, and so many in any case.
COPIES, FEWEST_COPIES = 1e-4, 100

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_PART:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def _addresses(text: str) -> Iterator[Span]:
    """Four numbers of a dotted chain at a time, from its left; the last numbers of a chain may be left over."""
    for chain in NUMBERS.finditer(text):
        numbers, start = chain[0].split("."), chain.start()
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                yield "ip", start, end
            start = end + 1


def _passes_luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(map(int, reversed(digits))):
        total += digit if i % 2 == 0 else (2 * digit if digit < 5 else 2 * digit - 9)
    return total % 10 == 0


def _cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _passes_luhn(digits):
            yield "card", m.start(), m.end()


def _phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield "phone", m.start(), m.end()


def spans_by_form(text: str) -> list[Span]:
    """Leftmost spans of each kind that do not overlap others of the kind, by start and then kind."""
    spans: list[Span] = []
    if "@" in text:
        spans += _emails(text)
    if DIGITS.search(text):
        spans += [*_addresses(text), *_cards(text)]
        if "+" in text:
            spans += _phones(text)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def identifiers(text: str, spans: list[Span]) -> Iterator[tuple[int, int]]:
    """Identifiers outside the given spans."""
    done, taken, k = 0, sorted((s, e) for _, s, e in spans), 0
    for m in DIGITS.finditer(text):
        if m.start() < done:
            continue
        start, end = m.start(), m.end()
        while start > done and text[start - 1] in IDENTIFIER:
            start -= 1
        while end < len(text) and text[end] in IDENTIFIER:
            end += 1
        done = end
        while end > m.end() and text[end - 1] in ".-+@_":
            end -= 1
        while start < m.start() and text[start] in ".-+@_":
            start += 1
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if end - start >= SHORTEST_IDENTIFIER and not any(s < end and e > start for s, e in taken[k : k + 4]):
            yield start, end


def contexts_of(text: str, starts: list[int]) -> Iterator[str | None]:
    """The two words or marks before each of the ascending places, in lower case; None where there is none.

    Reads backwards from every place, to the place before it at most, of which the words are
    known: the time is linear in the text. A word of more than ``LOOK`` characters goes by its digest.
    """
    def word(start: int, end: int) -> tuple[int, int, str]:
        own = text[start:end].lower()
        return start, end, own if len(own) <= LOOK else hashlib.sha256(own.encode()).hexdigest()

    known: list[tuple[int, int, str]] = []
    done, context = 0, None
    for start in starts:
        if start > done:
            width = LOOK
            while True:
                low = max(done, start - width)
                found = [m.span() for m in CONTEXT.finditer(text, low, start)]
                if low == done or len(found) > 2 or (len(found) == 2 and found[0][0] > low):
                    break
                width *= 4
            if low == done and known and found and known[-1][1] == done == found[0][0]:
                if CONTEXT.match(text, done - 1, done + 1).end() > done:  # one word on both sides of the place before
                    found[0] = (known.pop()[0], found[0][1])
            if low > done:
                known = []
            known = [*known, *[word(*span) for span in found[-2:]]][-2:]
            done = start
            context = " ".join(w for _, _, w in known) or None
        yield context


PLACE = "struct<kind:string,start:bigint,end:bigint,value:string,context:string>"
_PLACE = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("context", pa.string())])
)


def _places(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, places``: spans by form, and identifiers with a NULL kind."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = []
            for text in part.column(1).to_pylist():
                text = text or ""
                spans = spans_by_form(text)
                own = [(k, s, e) for k, s, e in spans]
                if DIGITS.search(text):
                    own += [(None, s, e) for s, e in identifiers(text, spans)]
                starts = sorted({s for _, s, _ in own})
                context = dict(zip(starts, contexts_of(text, starts)))
                found.append(
                    [{"kind": k, "start": s, "end": e, "value": text[s:e].lower(), "context": context[s]} for k, s, e in own]
                )
            yield pa.record_batch([part.column(0), part.column(2), pa.array(found, _PLACE)], names=["doc_id", "digest", "places"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(rows, f"doc_id {kind}, digest binary, places array<{PLACE}>")


def _totals(known: DataFrame) -> tuple[int, float]:
    return tuple(known.agg(F.count("*"), F.coalesce(F.sum("confidence"), F.lit(0.0))).first())


def _with_spans(places: DataFrame, more: DataFrame) -> DataFrame:
    """``places`` with ``more`` of their digest, NULL where it has none.

    A text of many copies is dealt out by a salt, and only its row of ``more`` is copied. Such texts
    are at most ``1 / COPIES``, so a table of them is broadcast.
    """
    limit = max(FEWEST_COPIES, int(places.count() * COPIES))
    copies = places.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    salts = F.broadcast(stored(copies.select("digest", F.ceil(F.col("n") / limit).alias("salts")), "copied-texts"))
    salt = F.pmod(F.xxhash64("doc_id") + F.spark_partition_id(), F.coalesce("salts", F.lit(1)))
    copied = more.join(salts, "digest", "left")
    copied = copied.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return places.join(salts, "digest", "left").withColumn("salt", salt).join(copied, ["digest", "salt"], "left")


def learn_contexts(
    edges: DataFrame, min_known: int = MIN_KNOWN, accept: float = ACCEPT, still: float = STILL
) -> tuple[DataFrame, DataFrame]:
    """Accepted ``context, kind, confidence`` and ``value, kind`` from distinct ``context, value, kind``.

    ``kind`` is NULL for identifiers of unknown kind. No round takes away what an earlier one added:
    confidences only grow, so the rounds come to an end.
    """
    seeds = edges.where("kind IS NOT NULL").select("value", "kind").distinct().withColumn("confidence", F.lit(1.0))
    links = stored(edges.select("context", "value").distinct(), "contexts")
    sizes = stored(links.groupBy("context").agg(F.count("*").alias("n")), "context-sizes")
    unseen = stored(
        edges.where("kind IS NULL").select("context", "value").distinct().join(seeds, "value", "left_anti"), "unseen"
    )
    seeds = stored(seeds, "seeds")
    known, before = seeds, _totals(seeds)
    while True:
        scored = links.join(known, "value").groupBy("context", "kind").agg(
            F.sum("confidence").alias("sum"), F.count("*").alias("known")
        )
        contexts = (
            scored.where(F.col("known") >= min_known)
            .join(sizes, "context")
            .select("context", "kind", (F.col("sum") / F.col("n")).alias("confidence"))
            .where(F.col("confidence") >= accept)
        )
        contexts = stored(contexts, "accepted-contexts")
        doubt = F.exp(F.sum(F.log(1.0 - F.least(F.col("confidence"), F.lit(1 - 1e-9)))))
        found = unseen.join(contexts, "context").groupBy("value", "kind").agg((1 - doubt).alias("confidence"))
        known = stored(seeds.unionByName(found.where(F.col("confidence") >= accept)), "known-instances")
        after = _totals(known)
        if after[0] == before[0] and after[1] - before[1] <= still * after[1]:
            break
        before = after
    return contexts, known.join(seeds.select("value"), "value", "left_anti").select("value", "kind")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", **learning) -> DataFrame:
    """``doc_id, spans``: spans of kind, start and end (code points, end exclusive) by start, then kind."""
    ship_package(docs.sparkSession)
    texts = keyed_texts(docs, key, text).withColumn("digest", text_digest("text"))
    places = stored(_places(texts), "places")
    every = places.where(F.size("places") > 0).select("digest", F.explode("places").alias("p")).select("digest", "p.*")
    edges = every.where("context IS NOT NULL").select("context", "value", "kind").distinct()
    contexts, instances = learn_contexts(stored(edges, "context-edges"), **learning)

    of_unknown = every.where("kind IS NULL AND context IS NOT NULL").select("digest", "context", "value", "start", "end").distinct()
    accepted = of_unknown.join(contexts.select("context", "kind"), "context").join(instances, ["value", "kind"])
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    more = accepted.select(
        "digest",
        F.struct(
            "start", (F.element_at(order, F.col("kind")) + len(KINDS)).alias("order"), "end", F.concat("kind", F.lit("_context")).alias("kind")
        ).alias("span"),
    )
    more = more.groupBy("digest").agg(F.collect_set("span").alias("more"))  # within one text
    base = F.transform(
        F.filter("places", lambda p: p["kind"].isNotNull()),
        lambda p: F.struct(
            p["start"].alias("start"), F.element_at(order, p["kind"]).alias("order"), p["end"].alias("end"), p["kind"].alias("kind")
        ),
    )
    joined = _with_spans(places.select("doc_id", "digest", base.alias("base")), more)
    spans = F.sort_array(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>"))))
    return joined.select(
        "doc_id",
        F.transform(
            spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
        ).alias("spans"),
    )
