import random

import numpy as np
import pandas as pd
import pytest

from siltstone.llm import leakage
from siltstone.llm.leakage import FMIndex, leaked_items, runs, suffix_array

ZH = "营业收入增长变动主要系汇率波动所致公司持续推进精细化管理并完善内部控制制度安排"


def test_suffix_array_and_search():
    r = np.random.RandomState(1)
    for _ in range(40):
        n, sigma = r.randint(1, 200), r.randint(2, 30)
        t = r.randint(0, sigma, n).astype(np.int32)
        assert suffix_array(t, sigma).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
        t = np.append(t + 1, 0).astype(np.int32)
        index = FMIndex(t, sigma + 1)
        patterns = r.randint(1, sigma + 1, (30, 2))
        for p, low, high in zip(patterns, *index.search(patterns.ravel(), np.arange(0, 60, 2), 2), strict=True):
            at = [i for i in range(n) if (t[i : i + 2] == p).all()]
            assert high - low == len(at) and sorted(index.locate(np.arange(low, high)).tolist()) == at
    assert suffix_array(np.zeros(50, np.int32), 1).tolist() == list(range(49, -1, -1))


def test_every_row_of_a_shard_is_located():
    """Equal short documents, so that many steps back cross a document's start."""
    r = np.random.RandomState(2)
    docs = [r.randint(97, 99, r.randint(1, 6)).astype(np.int32) for _ in range(60)]
    index, symbol, ends = leakage._indexed(docs)
    assert sorted(index.locate(np.arange(index.n)).tolist()) == list(range(index.n)) and ends[-1] == index.n - 1
    order = suffix_array(symbol[np.concatenate([*(np.append(d, 1) for d in docs), [0]])], index.sigma)
    assert index.locate(np.arange(index.n)).tolist() == order.tolist()


def passage(r, n=200):
    return "".join(r.choice(ZH + "一二三四五六七八九十甲乙丙丁") for _ in range(n))


def test_documents(spark):
    r = random.Random(4)
    items = [(i, passage(r)) for i in range(5)] + [(7, None), (8, "")]
    filler = lambda: passage(r, 300)
    whole, most = items[0][1], items[1][1]
    changed = list(items[2][1])
    for i in (20, 90, 150):
        changed[i] = "改"
    docs = [
        (1, filler() + whole + filler()), (2, filler() + most[100:160] + filler() + most[:60]), (3, "".join(changed)), (4, items[3][1][:60] + filler()), (5, filler()), (6, None), (7, " "),
        (8, " ".join(whole)), (9, "\n".join(x + "，" for x in (whole[i : i + 15] for i in range(0, 200, 15)))), (10, filler() * 300 + items[4][1]), (1, filler() + whole),
    ]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id bigint, text string, item_id string")
    table = spark.createDataFrame(items, "item_id bigint, passage string")
    got = leaked_items(df, "doc_id", "text", table).collect()
    assert sorted((x["doc_id"], x["item_id"]) for x in got) == [(1, 0), (1, 0), (2, 1), (3, 2), (8, 0), (9, 0), (10, 4)]
    first = next(x for x in got if x["covered"] == 1.0 and x["doc_id"] == 1)
    (span,) = first["spans"]
    assert any(span["end"] - span["start"] == 200 and d[1][span["start"] : span["end"]] == whole for d in docs if d[0] == 1)
    assert leaked_items(df.limit(0), "doc_id", "text", table).count() == 0 and leaked_items(df, "doc_id", "text", table.limit(0)).count() == 0


def test_shards_and_blocks_change_nothing(spark, monkeypatch, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/heldout_items.parquet")
    want = {(r["doc_id"], r["item_id"]) for r in leaked_items(docs, "doc_id", "text", items).collect()}
    monkeypatch.setattr(leakage, "BLOCK", 100)
    assert {(r["doc_id"], r["item_id"]) for r in leaked_items(docs, "doc_id", "text", items).collect()} == want
    pdf = docs.filter("text is not null").toPandas()[["doc_id", "text"]]
    monkeypatch.setattr(leakage, "SHARD", 20_000)
    search = leakage._searcher(items.toPandas(), 0.5)
    assert {(r.doc_id, r.item_id) for part in search(iter([pdf])) for r in part.itertuples()} == want


def plain(docs, items, share=0.5):
    """Every document against every item by their runs, without index and prefilter."""
    block = leakage.Items(items, share)
    want = set()
    for key, text in docs:
        letters, _ = leakage._letters(leakage.canonical(text))
        for group in block.groups:
            item, j, at, n = leakage._segments(letters, group, np.arange(len(group.number)))
            if not len(item):
                continue
            joins = leakage._joining(item, j, at, n, group)
            equal = {i: len({x for k in np.flatnonzero(joins & (item == i)) for x in range(j[k], j[k] + n[k])}) for i in range(len(group.number))}
            for i, number in enumerate(group.number):
                pieces = list(zip(j[item == i].tolist(), at[item == i].tolist(), n[item == i].tolist(), strict=True))
                common = runs(pieces, group.size, group.least)
                whole = len(block.codes[number])
                if equal[i] >= (1 - leakage.CHANGED) * share * whole and sum(b - a for a, b in leakage._merged([(a, b) for a, b, _, _ in common])) >= share * whole:
                    want.add((key, block.ids[number]))
    return want


def test_against_plain_comparison(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/heldout_items.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in leaked_items(docs, "doc_id", "text", items).collect()}
    assert got and got == plain([(d["doc_id"], d["text"]) for d in docs.filter("text is not null").collect()], items.toPandas())


EN = "revenue margin segment demand supply quarter pricing capacity order backlog region customer inventory product growth cost cash ratio debt asset".split()


def words(r, n):
    return "".join(r.choice(EN) for _ in range(n))


@pytest.mark.parametrize("every", [14, 16, 20, 24, 26, 28, 32])
def test_changed_letters_at_regular_places(spark, every):
    """A passage copied whole with one letter changed in every so many is a case, whatever windows that leaves unbroken."""
    r = random.Random(every)
    whole = words(r, 75)[:481]
    text = "".join("q" if i % every == every - 1 else c for i, c in enumerate(whole))
    docs = spark.createDataFrame([(1, words(r, 50) + text + words(r, 50)), (2, words(r, 300))], "doc_id bigint, text string")
    got = leaked_items(docs, "doc_id", "text", spark.createDataFrame([(1, whole)], "item_id bigint, passage string")).collect()
    assert [(x["doc_id"], x["item_id"]) for x in got] == [(1, 1)]


def test_planted_edits_against_plain_comparison(spark):
    """Random cuts, changes, insertions and losses, near and beyond the bound: index and plain comparison agree."""
    r = random.Random(11)
    items = [(i, words(r, 70) if i % 2 else passage(r, 240)) for i in range(12)]
    docs = []
    for d in range(150):
        key, own = r.choice(items)
        parts = []
        for _ in range(r.randint(1, 3)):
            a = r.randint(0, len(own) // 2)
            part = list(own[a : a + r.randint(20, len(own))])
            for _ in range(int(len(part) * r.choice([0, 0.02, 0.05, 0.08, 0.11, 0.15]))):
                at = r.randrange(len(part))
                part[at] = r.choice(["", "x", part[at] + "y", "改"])
            parts.append("".join(part))
        filler = (words if key % 2 else passage)(r, 60)
        docs.append((d, filler.join(parts) + filler))
    df, table = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")
    got = {(x["doc_id"], x["item_id"]) for x in leaked_items(df, "doc_id", "text", table).collect()}
    want = plain(docs, pd.DataFrame(items, columns=["item_id", "passage"]))
    assert got == want and 20 < len(want) < 150


def test_rare_letters_are_told_apart(spark):
    """Ideographs beyond the basic plane keep their identity."""
    r = random.Random(3)
    rare = "".join(chr(0x20000 + r.randrange(5000)) for _ in range(120))
    other = "".join(chr(0x20000 + r.randrange(5000)) for _ in range(120))
    df = spark.createDataFrame([(1, rare), (2, other)], "doc_id bigint, text string")
    got = leaked_items(df, "doc_id", "text", spark.createDataFrame([(5, rare)], "item_id bigint, passage string")).collect()
    assert [x["doc_id"] for x in got] == [1]


def test_a_good_part_of_a_bad_chain_counts():
    """Sixty equal letters count although the chain goes on with pieces in which too much differs."""
    pieces = [(0, 0, 60), *((60 + 18 * k + 12, 60 + 18 * k + 12, 6) for k in range(20))]
    assert (0, 60, 0, 60) in [(a, min(b, 60), c, min(d, 60)) for a, b, c, d in runs(pieces, 6, 20)]


def test_stored_index_serves_many_searches(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/heldout_items.parquet")
    shards = leakage.index(docs, "doc_id", "text")
    got = {(r["doc_id"], r["item_id"]) for part in (items.filter("item_id % 2 = 0"), items.filter("item_id % 2 = 1")) for r in leakage.search_index(shards, part).collect()}
    assert got == {(r["doc_id"], r["item_id"]) for r in leaked_items(docs, "doc_id", "text", items).collect()}
    assert leakage.search_index(shards, items.limit(0)).count() == 0
