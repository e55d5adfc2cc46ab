import math

import numpy as np
import pytest

from webtally.llm import pivot_index, queries
from webtally.llm.pivot_index import near_duplicates

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    """n_links and component of every vector by comparing all of equal label."""
    usable = {}
    for i, v, label in rows:
        ok = v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        if i is not None and ok:
            usable[i] = (np.array(v, np.float32).astype(float), label)
    links = {i: set() for i, _, _ in rows if i is not None}
    ids = sorted(usable)
    for label in {x[1] for x in usable.values()}:
        for size in {len(x[0]) for x in usable.values()}:
            own = [i for i in ids if usable[i][1] == label and len(usable[i][0]) == size]
            if own:
                v = np.stack([usable[i][0] / np.linalg.norm(usable[i][0]) for i in own])
                for a, b in zip(*np.nonzero(np.triu(v @ v.T, 1) >= threshold)):
                    links[own[a]].add(own[b])
                    links[own[b]].add(own[a])
    root = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = i
                todo += links[x]
    return {i: (len(links[i]), root[i], root[i] == i) for i in links}


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_recall_against_brute_force(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    expected, found = brute(rows), result(queries.op6_pivot_index(spark, folder))
    assert found.keys() == expected.keys()
    assert sum(x[0] for x in found.values()) >= 0.9 * sum(x[0] for x in expected.values())
    assert all(found[i][0] <= expected[i][0] for i in found)


def near(rng, v, cosine):
    u = rng.normal(size=v.shape)
    u -= (u @ v) * v / (v @ v)
    return cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine**2) * u / np.linalg.norm(u)


def test_planted_pairs_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "BLOCK_MEMBERS", 32)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=64).tolist(), i % 2) for i in range(600)]
    for i in range(200):  # right above the threshold, and right below it
        rows.append((1000 + i, near(rng, np.array(rows[i][1]), 0.9305 if i % 2 else 0.929).tolist(), rows[i][2]))
    rows += [(2000 + i, near(rng, np.array(rows[5][1]), 0.99).tolist(), 1) for i in range(200)]
    rows += [(3000 + i, rows[6][1], 0) for i in range(150)]
    expected, found = brute(rows), result(near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    total = lambda x: sum(n for n, _, _ in x.values())
    assert 0.99 * total(expected) <= total(found) <= total(expected)
    assert all(found[3000 + i] == expected[3000 + i] for i in range(150))


def test_unusable_vectors_and_other_edges(spark):
    one = [1.0, 0.0, 2.0]
    rows = [
        (1, one, 1), (2, one, 1), (3, one, None), (4, one, 2), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1),
        (8, [1.0, None, 2.0], 1), (9, [1.0, float("nan"), 2.0], 1), (10, [float("inf"), 0.0, 2.0], 1),
        (11, [1.0, 0.0], 1), (12, [2.0, 0.0], 1), (13, [-1.0, 0.0, -2.0], 1), (14, [1e30, 0.0, 2e30], 1), (14, [1e30, 0.0, 2e30], 1),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", pivot string")
    found = result(near_duplicates(df))
    assert found == {i: (0, i, True) for i in range(1, 15)} | {
        1: (2, 1, True), 2: (2, 1, False), 14: (2, 1, False), 11: (1, 11, True), 12: (1, 11, False)
    }
    assert len(near_duplicates(df).collect()) == 14
    assert near_duplicates(df.limit(0)).count() == 0
    without = spark.createDataFrame([(None, one, 1), (None, one, 1), (3, one, 1)], SCHEMA)
    assert sorted(map(tuple, near_duplicates(without).collect()), key=str) == [
        (3, 0, 3, True), (None, 0, None, True), (None, 0, None, True)
    ]


@pytest.mark.parametrize("cosine", [0.91, 0.95])
def test_recall_in_a_group_of_a_third_of_the_rows(spark, cosine):
    rng = np.random.default_rng(5)
    n, hot = 21_000, 7_000
    v = rng.normal(size=(n, 64))
    centre = rng.normal(size=64)
    spread = v[:hot] - np.outer(v[:hot] @ centre, centre) / (centre @ centre)
    spread /= np.linalg.norm(spread, axis=1, keepdims=True)
    v[:hot] = math.sqrt(cosine) * centre / np.linalg.norm(centre) + math.sqrt(1 - cosine) * spread
    v = v.astype(np.float32)
    unit = v / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    expected = sum(int((unit[a : a + 1000] @ unit.T >= 0.93).sum()) for a in range(0, n, 1000)) - n
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], SCHEMA)
    found = near_duplicates(df).agg({"n_links": "sum"}).first()[0]
    assert 0.99 * expected <= found <= expected
