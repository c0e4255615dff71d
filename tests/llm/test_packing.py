import itertools
import random

import numpy as np

from siltstone.llm.packing import cut_texts, fullest, least_containers, pack, packing, unused_room

DOCS = "doc_id bigint, text string, spec_id bigint"


def test_fullest_against_all_subsets():
    r = random.Random(1)
    for _ in range(200):
        xs = [r.randint(1, 30) for _ in range(r.randint(1, 9))]
        room = r.randint(1, 60)
        counts = {x: xs.count(x) for x in xs}
        got = fullest(sorted(counts), counts, room)
        assert sum(got) == max(s for n in range(len(xs) + 1) for c in itertools.combinations(xs, n) if (s := sum(c)) <= room)
        assert all(got.count(x) <= xs.count(x) for x in got)


def test_pack_uses_each_item_once():
    r = random.Random(2)
    sizes = [r.randint(1, 999) for _ in range(600)]
    boxes = pack(sizes, 1000)
    assert sorted(i for b in boxes for i in b) == list(range(600))
    assert all(sum(sizes[i] for i in b) <= 1000 for b in boxes)
    assert len(boxes) <= 1.04 * sum(sizes) / 1000 + 1


def fewest(sizes, capacity):
    """Containers of an optimal packing, by trying all."""
    best = len(sizes)

    def place(i, boxes):
        nonlocal best
        if len(boxes) >= best:
            return
        if i == len(sizes):
            best = len(boxes)
            return
        for k in range(len(boxes)):
            if boxes[k] + sizes[i] <= capacity and boxes[k] not in boxes[:k]:
                place(i + 1, [*boxes[:k], boxes[k] + sizes[i], *boxes[k + 1 :]])
        place(i + 1, [*boxes, sizes[i]])

    place(0, [])
    return best


def test_lower_bound_never_exceeds_the_optimum():
    r = random.Random(4)
    tight = 0
    for _ in range(200):
        capacity = r.randint(5, 40)
        sizes = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 8))), reverse=True)
        distinct = sorted(set(sizes))
        bound, best = least_containers(np.array(distinct), np.array([sizes.count(s) for s in distinct]), capacity), fewest(sizes, capacity)
        assert -(-sum(sizes) // capacity) <= bound <= best
        tight += bound == best
    assert tight > 150


def test_full_pieces_have_containers_of_their_own(spark):
    df = spark.createDataFrame([(i, "a" * 350) for i in range(300)], "doc_id bigint, text string")
    got = packing(df, spark.createDataFrame([(1, 100)], "spec_id bigint, capacity_tokens bigint")).filter("tokens = 100").select("block", "container").collect()
    assert len(got) == len(set(got)) == 900


def test_table(spark):
    rows = [(i, "字" * (i % 7 + 1) + "a" * i, 9) for i in range(40)] + [(100, None, 9), (101, " \u3000", 9), (102, "x" * 250, 9), (103, "y" * 100, 9), (104, "y" * 200, 9), (105, "", 9), (106, "y" * 100, 9)]
    df = spark.createDataFrame(rows, DOCS)
    specs = spark.createDataFrame([(1, "s", 100), (2, "m", 1000), (3, "none", None)], "spec_id bigint, spec_name string, capacity_tokens bigint")
    plan = packing(df, specs, block=10)
    got = plan.collect()
    sizes = {r[0]: len(r[1].encode()) for r in rows if r[1] and r[1].strip()}
    for spec, capacity in ((1, 100), (2, 1000)):
        mine = [r for r in got if r["spec_id"] == spec]
        assert {d: sum(r["tokens"] for r in mine if r["doc_id"] == d) for d in sizes} == sizes
        boxes = {}
        for r in mine:
            boxes[r["block"], r["container"]] = boxes.get((r["block"], r["container"]), 0) + r["tokens"]
        assert max(boxes.values()) <= capacity
    assert {tuple(r) for r in cut_texts(plan).collect()} == {(1, d) for d, n in sizes.items() if n > 100}
    room = {r["spec_id"]: r for r in unused_room(plan, specs).collect()}
    assert room[2]["tokens"] == sum(sizes.values()) and all(r["least_containers"] <= r["containers"] for r in room.values())
    assert packing(df.limit(0), specs).count() == 0 and packing(df, specs.limit(0)).count() == 0
