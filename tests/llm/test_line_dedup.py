import random

from webtally.llm.line_dedup import dedup_lines

LONG = "this is a line that is long enough to be counted"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(docs, min_docs=5):
    holders = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        gone = lambda x: i is not None and len(holders.get(key(x), ())) >= min_docs and max(holders[key(x)]) != i
        kept = [x for x in lines if not gone(x)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def result(df, **options):
    rows = dedup_lines(df, **options).select("doc_id", "deduped.*").collect()
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in rows), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    pool = [f"{LONG} {i}" for i in range(30)] + ["short", "", "é" * 40, "É" * 40, "x" * 39]
    docs = [(i, "\n".join(rng.choice([" ", "", "\t"]) + rng.choice([str.upper, str])(rng.choice(pool)) for _ in range(rng.randrange(6)))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert any(x[3] for x in brute(docs))
    assert result(df) == brute(docs)
    assert result(df, batches=1) == brute(docs)


def test_edge_cases(spark):
    docs = [(i, LONG) for i in range(6)] + [(5, LONG + "\nx"), (None, LONG), (7, None), (8, ""), (9, "y" * 500_000), (10, f"{LONG}\n" * 3)]
    df = spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id bigint, text string, line string, dropped int")
    assert result(df) == brute(docs)
    assert dedup_lines(df).columns == [*df.columns, "deduped"]
    assert result(df.limit(0)) == []
