import itertools
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from siltstone.llm import near_duplicates as N
from siltstone.llm.near_duplicates import HASHES, SHINGLE, components, depth_for, group_pairs, most_unlike, near_duplicates, shingle_hashes, signature, similar_pairs


def grams(t):
    return {t[i : i + SHINGLE] for i in range(len(t) - SHINGLE + 1)}


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def texts(n=60, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz中文报告营业收入增长变动") for _ in range(200))
    out = []
    for i in range(n):
        t = word()
        out.append(t)
        if i % 3 == 0:  # small edits
            u = list(t)
            for _ in range(r.randint(1, 6)):
                u[r.randrange(len(u))] = "X"
            out.append("".join(u))
        if i % 10 == 0:
            out.append(t)  # an exact copy
    return out


def test_signature_estimates_jaccard():
    a, b = texts()[0], texts()[1]
    same = (signature(shingle_hashes(a)) == signature(shingle_hashes(b))).mean()
    assert abs(same - jaccard(a, b)) < 0.15
    long = "".join(texts(30))
    assert np.array_equal(signature(shingle_hashes(long)), signature(np.unique(shingle_hashes(long))))


def test_depth_meets_recall():
    for t in (0.5, 0.8):
        d = depth_for(t, 0.9)
        assert 1 - (1 - t**d) ** 20 >= 0.9


def test_pairs_against_brute_force(spark):
    data = sorted(set(texts()))
    df = spark.createDataFrame(list(enumerate(data)), "rep bigint, t string")
    for threshold in (0.5, 0.8):
        true = {(i, j) for i, j in itertools.combinations(range(len(data)), 2) if jaccard(data[i], data[j]) >= threshold}
        got = {tuple(x) for x in similar_pairs(df, threshold).collect()}
        assert got <= true and len(got) >= 0.9 * len(true) and true


def crowd(n=400, seed=5):
    """Texts of shared boilerplate (unrelated ones at about 0.39), every second with a partner at about 0.55."""
    r = random.Random(seed)
    letters = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    shared, out = letters(170), []
    for _ in range(n):
        own = letters(130)
        out += [shared + own, shared + own[:44] + letters(86)]
    return out


def true_pairs(data, threshold):
    sets = [grams(t) for t in data]
    return {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if (n := len(sets[i] & sets[j])) >= threshold * (len(sets[i]) + len(sets[j]) - n)}


def test_crowded_prefixes(spark):
    data = crowd()
    df = spark.createDataFrame(list(enumerate(data)), "rep bigint, t string")
    true = true_pairs(data, 0.5)
    assert len(true) >= 400
    got = {tuple(x) for x in similar_pairs(df, 0.5).collect()}
    assert got <= true and len(got) >= 0.9 * len(true)
    # Runs of over 40 rows go block against block, with the same result.
    assert {tuple(x) for x in similar_pairs(df, 0.5, block=40).collect()} == got


def test_tasks_do_not_matter(spark):
    data = crowd(60)
    df = spark.createDataFrame(list(enumerate(data)), "rep bigint, t string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = []
        for n in (1, 12):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append({tuple(x) for x in similar_pairs(df, 0.5).collect()})
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got[0] == got[1] and got[0]


def test_links_of_a_large_group(spark):
    r = random.Random(7)
    base = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300))
    data = [base[: 100 + i % 100] + f"{i:05d}" + base[100 + i % 100 :] for i in range(400)]
    got = near_duplicates(spark.createDataFrame(list(enumerate(data)), "row_id bigint, t string"), 0.8).select("group_id", "links").distinct().collect()
    assert [tuple(x) for x in got] == [(0, 399)]


def test_sketch_counts_in_the_recall():
    for t in (0.3, 0.5, 0.8):
        equal = (1 + 3 * t) / 4
        kept = sum(math.comb(HASHES, k) * equal ** (HASHES - k) * (1 - equal) ** k for k in range(most_unlike(t) + 1))
        assert kept * (1 - (1 - t ** depth_for(t, 0.9)) ** 20) >= 0.9


def test_groups_and_edges(spark):
    data = texts()
    rows = list(enumerate(data)) + [(900, None), (901, ""), (902, "abc"), (903, "abc"), (904, "abcd")] + [(1000 + i, "同一段文字完全相同的内容" * 3) for i in range(50)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "row_id bigint, t string, group_id string")
    got = {r["row_id"]: r for r in near_duplicates(df, 0.5).collect()}
    assert not {900, 901} & got.keys()
    assert got[902]["group_id"] == got[903]["group_id"] == 902 and got[904]["group_id"] == 904
    assert {got[1000 + i]["class_id"] for i in range(50)} == {1000}
    parent = list(range(len(data)))
    for i, j in itertools.combinations(range(len(data)), 2):
        if data[i] == data[j] or jaccard(data[i], data[j]) >= 0.5:
            a, b = parent[i], parent[j]
            parent = [min(a, b) if p in (a, b) else p for p in parent]
    wanted = {(i, j) for i, j in itertools.combinations(range(len(data)), 2) if parent[i] == parent[j]}
    pairs = {tuple(x) for x in group_pairs(near_duplicates(df, 0.5)).collect() if x[1] < 900}
    assert pairs <= wanted and len(pairs) >= 0.9 * len(wanted)


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(path + star + star[:3], "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(1, 41)} == {0} and {got[i] for i in range(101, 160)} == {100}


def test_empty(spark):
    df = spark.createDataFrame([], "row_id bigint, t string")
    assert near_duplicates(df, 0.5).count() == 0


def test_finer_sketch_counts_hashes_that_differ(spark):
    """The pairs' words in the JVM give what the bits of the hashes give."""
    texts = [(i, "".join(random.Random(i // 2).choice("abcdefghijklmnop") for _ in range(200 + 10 * i))) for i in range(6)]
    batch = pd.DataFrame(texts, columns=["rep", "t"])
    (signed,) = N._signed(3)(iter([batch]))
    mixed = [N._mix(N.signature(N.shingle_hashes(t)).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(15) for _, t in texts]
    df = spark.createDataFrame(signed.drop(columns="tops"))
    side = lambda end: df.select(F.col("rep").alias(end), *[F.col(c).alias(f"{end}{c}") for c in N._FINE])
    got = {(r["a"], r["b"]): r["n"] for r in side("a").crossJoin(side("b")).select("a", "b", N._differing("a", "b").alias("n")).collect()}
    assert got == {(i, j): int((mixed[i] != mixed[j]).sum()) for i in range(6) for j in range(6)}


def test_recall_at_the_threshold(spark):
    """Planted pairs just above the threshold, among texts that share a third of theirs, are found at the stated rate."""
    r = random.Random(9)
    letters = [chr(0x4E00 + i) for i in range(400)]
    shared = "".join(r.choice(letters) for _ in range(80))
    text = lambda n: "".join(r.choice(letters) for _ in range(n))
    rows, pairs = [], set()
    for i in range(0, 1200, 2):
        a = text(240)
        k = int(240 * r.uniform(0.56, 0.6))
        x, y = shared + a, shared + a[:k] + text(240 - k)
        p, q = set(N._shingles(x).tolist()), set(N._shingles(y).tolist())
        rows += [(i, x), (i + 1, y)]
        if 0.5 <= len(p & q) / len(p | q) < 0.56:
            pairs.add((i, i + 1))
    df = spark.createDataFrame(rows, "rep bigint, t string")
    got = {(x["a"], x["b"]) for x in N.similar_pairs(df, 0.5, 0.9).collect()}
    assert len(pairs) > 300 and len(pairs & got) >= 0.9 * len(pairs)
