"""Near-duplicates against brute force: large groups, hot buckets, clusters of many blocks, repeated ids, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from sardabir.llm import neardup
from sardabir.llm.components import connected_components, few_edges
from test_operators import odd

SMALL, SOME = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def shingle_set(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\x0b\f\r" else c for c in text or "").split(" ") if w]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows, percent=85):
    """The least id that each row (id, text) reaches; by row, as ids may repeat."""
    sets, label = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        shared = {}
        for g in s:
            for j in holders.setdefault(g, []):
                shared[j] = shared.get(j, 0) + 1
            holders[g].append(i)
        for j, n in shared.items():
            if rows[i][0] is not None and rows[j][0] is not None and 100 * n >= percent * (len(s) + len(sets[j]) - n):
                label[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min((k for k in (key, least.get(find(i))) if k is not None), default=None)
    return [least[find(i)] for i in range(len(rows))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def told(spark, rows, **how):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(frame(spark, rows), **how).collect()), key=repr)


def wanted(rows, percent=85):
    return sorted(((k, len(shingle_set(t)), c, k is None or k == c) for (k, t), c in zip(rows, brute(rows, percent))), key=repr)


def near_copies(n, words, changes, seed=6):
    rng, base = random.Random(seed), [f"w{k}" for k in range(words)]
    texts = []
    for _ in range(n):
        new = base[:]
        for _ in range(rng.randint(*changes)):
            new[rng.randrange(words)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(new))
    return texts


@pytest.mark.parametrize(("hot", "shingles", "percent", "exact"), [(8192, 1 << 20, 85, True), (20, 3000, 85, False), (50, 1500, 80, False)])
def test_a_large_group_of_near_copies(spark, monkeypatch, hot, shingles, percent, exact):
    # small bounds, so that buckets are shared by several tasks, and clusters go through all their steps
    monkeypatch.setattr(neardup, "HOT", hot)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles)
    texts = near_copies(200, 150, (0, 5)) + near_copies(40, 60, (1, 2), 7) + [f"{t} and a tail of words that only these have got" for t in near_copies(30, 150, (0, 1), 8)]
    texts += texts[:30]
    rows = list(zip(random.Random(1).sample(range(10**6), len(texts)), texts))
    assert told(spark, rows, percent=percent, exact=exact) == wanted(rows, percent)


def test_edges_are_about_as_few_as_members(spark):
    rows = list(enumerate(near_copies(2000, 120, (0, 4), 9)))
    at = neardup.bars(85)
    described = neardup.map_rows(frame(spark, rows).select("doc_id", F.xxhash64("text"), "text"), lambda b: neardup._describe(b, at), "id long,text_hash long,n_shingles long,digest binary,bands array<long>,packed binary")
    classes = described.dropDuplicates(["digest"]).withColumnRenamed("id", "node").checkpoint()
    edges = neardup._cluster_edges(classes, at)
    assert few_edges(edges)[0].count() <= 1.3 * classes.count()


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + k, 401 + k) for k in range(120)] + [(999, 600 + k) for k in range(150)] + [(7, 7), (None, 1), (2, None)]
    label = {}
    find = lambda i: i if label.setdefault(i, i) == i else find(label[i])
    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            label[b] = a
    got, n = connected_components(spark.createDataFrame(edges, "a long, b long"))
    got = got.collect()
    assert {r["node"]: r["component"] for r in got} == {i: find(i) for i in label} and n == len(label)
    assert connected_components(spark.createDataFrame([], "a long, b long"))[1] == 0


A, B = " ".join(f"a{k}" for k in range(400)), " ".join(f"b{k}" for k in range(400))


@pytest.mark.parametrize("turned", [False, True])
def test_rows_that_repeat_an_id(spark, turned):
    rows = [(1, A), (4, A), (4, B)]
    rows = rows[::-1] if turned else rows
    assert told(spark, rows) == wanted(rows) == [(1, 396, 1, True), (4, 396, 1, False), (4, 396, 4, True)]
    assert sorted(map(tuple, neardup.drop_copies(frame(spark, rows)).collect())) == [(1, A), (4, B)]
    rows = [(5, A), (5, B), (7, A + " one"), (8, B + " one")]
    rows = rows[::-1] if turned else rows
    assert told(spark, rows) == wanted(rows)
    assert sorted(map(tuple, neardup.drop_copies(frame(spark, rows)).collect())) == [(5, A), (5, B)]


def test_one_row_stays_of_rows_that_are_repeated(spark):
    rows = [(1, A), (1, A), (1, A + " one"), (2, A), (3, ""), (3, ""), (None, A), (None, A), (9, B)]
    got = neardup.drop_copies(frame(spark, rows)).collect()
    assert sorted(map(repr, (tuple(r) for r in got if r[0] not in (1,)))) == sorted(map(repr, [(3, ""), (3, ""), (None, A), (None, A), (9, B)]))
    assert [r[1] in (A, A + " one") for r in got if r[0] == 1] == [True]


def test_near_duplicates_of_odd_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in odd(spark).collect()]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(odd(spark)).collect()), key=repr)
    assert got == wanted(rows)
    kept = neardup.drop_copies(odd(spark))
    assert kept.columns == odd(spark).columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7, 8]
    assert neardup.near_duplicates(odd(spark).limit(0)).count() == neardup.drop_copies(odd(spark).limit(0)).count() == 0


def test_an_estimate_loses_no_link_of_the_documents(spark):
    docs = spark.read.parquet(f"{SOME}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    for percent in (80, 85):
        assert told(spark, rows, percent=percent) == wanted(rows, percent)
