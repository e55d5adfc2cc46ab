import hashlib
import random
import zlib

import pytest

from webtally.llm import prefix_trie as pt

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(rebuilt):
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    out = {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        below = [out[k] for k in children.get(node, [])]
        ends = ",".join(map(str, sorted(c for c in members[node] if len(rebuilt[c]) == len(node))))
        out[node] = (
            min(members[node]),
            len(node),
            min(members[node[:-1]]) if node else None,
            len(members[node]),
            len(below),
            sum(x[5] for x in below) or 1,
            own + sum(x[6] for x in below),
            hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(out.values(), key=str)


def result(spark, rows, block=4096, heavy=1000, queue=100_000, extra=()):
    df = spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA + ", node string, depth int" * bool(extra))
    turns = pt.ordered_turns(df)
    nodes = pt.prefix_trie(*pt.rebuilt(turns, block), block, heavy, queue)
    return sorted((tuple(r) for r in nodes.collect()), key=str)


def some_rows(n=40, longest=14, seed=5):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "ü", ""]) if t < 4 else "same"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, heavy, queue", [(3, 2, 2), (1, 0, 1)])
def test_equals_brute_force(spark, block, heavy, queue):
    rows = some_rows()
    assert result(spark, rows, block, heavy, queue) == brute(brute_rebuilt(rows))


def test_one_conversation_of_many_turns(spark):
    """Longer than many blocks; a path whose totals pass through all of them."""
    rows = [(0, t, "user", "x" * (t % 3)) for t in range(300)] + [(5, t, "user", "x" * (t % 3)) for t in range(290)]
    assert result(spark, rows, block=7, heavy=5, queue=4) == brute(brute_rebuilt(rows))


def test_one_conversation_repeated(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 600, 5) for t in range(6)]
    nodes = result(spark, rows, heavy=10)
    assert nodes == brute(brute_rebuilt(rows))
    assert max(n[3] for n in nodes) == 120


def test_edge_cases(spark):
    rows = [
        (7, None, None, None), (7, None, "user", "b"), (7, 1, "user", "b"), (7, 1, "user", "b"), (None, 1, "user", "lost"),
        (8, 2, "user", "ü" * 100_000), (-3, 0, "", ""), (9, -5, "assistant", "x"),
    ]
    rebuilt = {}
    for c, turns in brute_rebuilt([r for r in rows if r[0] is None or r[0] >= 0]).items():
        rebuilt[c] = turns
    # SQL's remainder keeps the sign, so the group of -3 starts with 0, which is absent
    h = zlib.crc32(b"-3") % 9
    rebuilt[-3] = [("", "")][h:]
    assert result(spark, rows, extra=("clash", 1)) == brute(rebuilt)
    assert result(spark, []) == []


def test_conversation_without_turns_left(spark):
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    rows = [(c, 0, "user", "a")]
    assert result(spark, rows) == brute({c: []})


def test_queue_spills_and_keeps_order():
    rng = random.Random(1)
    entries = [((-rng.randrange(40), bytes([rng.randrange(4)])), rng.randrange(9), 1) for _ in range(2000)]
    queue = pt.SpillingQueue(10)
    for e in entries:
        queue.push(*e)
    want = {}
    for key, a, b in entries:
        x, y = want.get(key, (0, 0))
        want[key] = (x + a, y + b)
    assert len(queue.heap) <= 10 and len(queue.heads) <= 17
    assert [queue.pop(k) for k in sorted(want)] == [want[k] for k in sorted(want)]
    assert queue.pop((0, b"none")) == (0, 0)
