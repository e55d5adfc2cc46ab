import hashlib
import random
import re

from webtally.llm import pii, queries
from webtally.llm.pii import find, spans_by_form

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    spans = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        spans += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text or "") if passes(kind, m[0])]
    return [(kind, start, end) for start, _, end, kind in sorted(spans)]


def collected(df):
    return sorted(((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in df.collect()), key=str)


def test_forms_equal_brute_force():
    rng = random.Random(7)
    bits = list("ab@.-_%+ ()0159é\n") + ["1.2.3.4", "255", "256", "@x.y", "a@b.c", "4111 1111 1111 1111", "+1 (555) 123-4567", "00",
                                        "4111-1111", "٣", ".", "-", " "]
    for _ in range(20_000):
        text = "".join(rng.choices(bits, k=rng.randrange(16)))
        assert spans_by_form(text) == brute(text), text
    for text in ("a@b.cd_x@y.zz", "1.2.3.4.5.6.7.8", "1.2.3.4.5", "000255.0.0.0", "1" * 4000 + ".1.1.1"):
        assert spans_by_form(text) == brute(text)


def test_long_texts_take_linear_time():
    for text in ("a" * 2_000_000 + "@", "1" * 2_000_000, "a@" * 500_000, "+1" * 500_000, "1." * 500_000, "+" + "1 " * 500_000 + "x"):
        assert isinstance(spans_by_form(text), list)


def test_identifiers_are_outside_of_spans():
    text = "id A-12345, mail a1@b.cc, x1, 99.99.99.99 ...v1.2.3-beta... 77777"
    found = [text[s:e] for s, e in pii.identifiers(text, spans_by_form(text))]
    assert found == ["A-12345", "v1.2.3-beta", "77777"]


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(1)
    word = lambda: f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"
    docs = []
    for i in range(60):  # a context of e-mail addresses, with a few handles of another form
        value = f"user{i}@mail.org" if i % 10 else f"handle_{i}x"
        docs.append((i, f"{word()} {word()} contact mail {value} {word()}"))
    for i in range(100, 140):  # a context of numbers that are no personal data
        docs.append((i, f"{word()} order number {10**6 + i} {word()} or order number 10.0.0.{i % 7}"))
    for i in range(200, 212):  # known by the handles found in the first context, and one more
        docs.append((i, f"please write to handle_{(i - 200) % 6 * 10}x {word()}" if i < 211 else "please write to stranger77 now"))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = dict(collected(find(df)))
    for i, text in docs:
        base = [s for s in found[i] if not s[0].endswith("_context")]
        assert base == brute(text)
        more = [(k, text[s:e]) for k, s, e in found[i] if k.endswith("_context")]
        if i < 60 and i % 10 == 0:
            assert more == [("email_context", f"handle_{i}x")]
        elif 200 <= i < 211:
            assert more == [("email_context", text.split()[3])]
        elif i == 211:
            assert more == [("email_context", "stranger77")]
        else:
            assert not more, (i, text, more)


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "x a@b.cc", "c"), (4, "x a@b.cc", "d"), (4, "x a@b.cc", "d"), (4, "none", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, digest string")
    span = [("email", 2, 8)]
    assert collected(find(df)) == sorted([(1, []), (2, []), (None, span), (4, span), (4, span), (4, [])], key=str)
    assert find(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op9_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts) and all(sum(r[f"n_{k}"] for r in rows) for k in PATTERNS)
    for r in rows:
        spans = brute(texts[r["doc_id"]])
        written = [f"{k}:{s}:{e}" for k, s, e in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in spans) for k in PATTERNS]


def plain_context(text, start):
    words = [w.lower() for w in pii.CONTEXT.findall(text[:start])[-2:]]
    return " ".join(w if len(w) <= 48 else hashlib.sha256(w.encode()).hexdigest() for w in words) or None


def test_contexts_reach_as_far_as_it_takes():
    rng = random.Random(9)
    bits = ["a", "bé", "word", " ", "\n", " " * 60, "x" * 47, "x" * 48, "y" * 300, "1", "_", ":", "22", "\u0301", "٣"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randrange(14)))
        starts = sorted(rng.sample(range(len(text) + 1), min(len(text), rng.randrange(6))))
        assert list(pii.contexts_of(text, starts)) == [plain_context(text, s) for s in starts], (text, starts)
    long = [("w w" + " " * 10**6, 6), ("w" * 10**6 + " 1", 500_001), ("id no " + "12345 " * 200_000, 6), ("w" * 10**6 + " 12345" * 100_000, 6)]
    for text, step in long:
        starts = list(range(10**6 + 1 if text[:3] == "www" else 0, len(text), step))
        assert len(list(pii.contexts_of(text, starts))) == len(starts)


def plain_rounds(texts, min_known=5, accept=0.8):
    """Spans that contexts add, by rounds in plain Python until nothing changes."""
    places, edges, kinds = {}, {}, {}
    for text in set(texts):
        spans = [s for s in brute(text)]
        places[text] = [(text[s:e].lower(), plain_context(text, s), s, e) for s, e in pii.identifiers(text, spans)]
        for value, context, *_ in places[text]:
            edges.setdefault(context, set()).add(value)
        for kind, s, e in spans:
            edges.setdefault(plain_context(text, s), set()).add(text[s:e].lower())
            if plain_context(text, s):
                kinds.setdefault(text[s:e].lower(), {})[kind] = 1.0
    edges.pop(None, None)
    unseen = {v for own in places.values() for v, c, *_ in own if c} - kinds.keys()
    known, found = dict(kinds), None
    while True:
        accepted = {}
        for context, values in edges.items():
            for kind in pii.KINDS:
                have = [known[v][kind] for v in values if kind in known.get(v, {})]
                if len(have) >= min_known and sum(have) / len(values) >= accept:
                    accepted[context, kind] = sum(have) / len(values)
        doubt = {}
        for own in places.values():
            for value, context in {(v, c) for v, c, *_ in own}:
                for kind in pii.KINDS:
                    if value in unseen and (context, kind) in accepted:
                        doubt.setdefault(value, {}).setdefault(kind, {})[context] = 1 - min(accepted[context, kind], 1 - 1e-9)
        now = {}
        for value, by_kind in doubt.items():
            for kind, doubts in by_kind.items():
                rest = 1.0
                for x in doubts.values():
                    rest *= x
                if 1 - rest >= accept:
                    now.setdefault(value, {})[kind] = 1 - rest
        if now == found:
            break
        found, known = now, kinds | now
    return {
        text: sorted((k, s, e) for v, c, s, e in own for k in found.get(v, {}) if (c, k) in accepted) for text, own in places.items()
    }


def test_rounds_go_on_until_nothing_is_added(spark):
    """A chain of contexts, each known by the identifiers found in the one before: six rounds."""
    docs, name = [], [f"c{chr(97 + k)}" for k in range(7)]
    docs += [f"mail to user{i}@mail.org" if i >= 8 else f"mail to level0x{i}" for i in range(40)]
    for k in range(1, 7):  # 36 known of 52 are too few, without those of the level before
        docs += [f"see {name[k]} user{i}@mail.org" for i in range(36)]
        docs += [f"see {name[k]} level{j}x{i}" for j in (k - 1, k) for i in range(8)]
    rng = random.Random(12)
    for i in range(300):
        value = rng.choice([f"u{rng.randrange(30)}@x.org", f"10.0.0.{rng.randrange(30)}", f"code{rng.randrange(40)}", f"nr{rng.randrange(400)}"])
        docs.append(f"{rng.choice('pqrst')} {rng.choice(['is', 'of'])} {value} end")
    docs += [docs[0]] * 300 + [docs[3]] * 150  # copies beyond what is dealt out together
    expected = plain_rounds(docs)
    assert all(own for t, own in expected.items() if "level" in t)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    rows = collected(find(df))
    assert len(rows) == len(docs)
    for i, spans in rows:
        more = sorted((k.removesuffix("_context"), s, e) for k, s, e in spans if k.endswith("_context"))
        assert more == expected[docs[i]], docs[i]


def test_copies_of_a_text_are_dealt_out(spark):
    rows = [(i if i % 3 else None, "digest" if i < 900 else f"d{i}") for i in range(1200)]
    places = spark.createDataFrame(rows, "doc_id bigint, digest string")
    more = spark.createDataFrame([("digest", 1), ("d1000", 2)], "digest string, more int")
    dealt = pii._with_spans(places, more)
    assert sorted((r["digest"], r["more"]) for r in dealt.collect() if r["more"]) == [("d1000", 2)] + [("digest", 1)] * 900
    salts = [r["count"] for r in dealt.where("digest = 'digest'").groupBy("salt").count().collect()]
    assert dealt.count() == 1200 and len(salts) >= 8
