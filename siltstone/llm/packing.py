"""Texts packed into containers of fixed capacity with little unused room.

Sizes are counted in tokens of the byte-level tokenizer: one for each byte of
the UTF-8 text. Only a text larger than the container is cut: into full
containers and a rest, which is packed like a whole text.

Minimum bin slack: each container starts with the largest item left; a bitset
subset-sum over the lengths still available finds the combination that fills
the room best, and these items are removed. Items are dealt to blocks by a hash
of their id, and blocks are packed side by side; only the last containers of a
block can be far from full, so the loss is one container in some hundreds.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.repeated_lines import NOT_BLANK

#: Items of a block; bounds the memory and time of one packing.
BLOCK = 4_000


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Lengths, from those available, whose sum comes closest to `room` from below.

    lengths: the available lengths in ascending order; counts: how many of each.
    Bit s of the bitset says that the sum s can be reached; the bitsets of all
    steps are kept, so that the combination can be read backwards.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    goal = 1 << room
    for at in range(bisect_right(lengths, room) - 1, -1, -1):
        size = lengths[at]
        for _ in range(min(counts[size], room // size)):
            wider = reach | (reach << size) & mask
            if wider == reach:
                break
            steps.append((size, reach))
            reach = wider
            if reach & goal:
                break
        if reach & goal:
            break
    best, chosen = reach.bit_length() - 1, []
    for size, before in reversed(steps):
        if best >= size and not before >> best & 1:
            chosen.append(size)
            best -= size
    return chosen


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of places in `sizes`; every size is at most `capacity`."""
    places: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), reverse=True):
        places.setdefault(sizes[i], []).append(i)
    lengths = sorted(places)
    counts = {s: len(p) for s, p in places.items()}
    out = []

    def take(size: int) -> int:
        counts[size] -= 1
        if not counts[size]:
            del lengths[bisect_right(lengths, size) - 1]
        return places[size].pop()

    while lengths:
        largest = lengths[-1]
        box = [take(largest)]
        if capacity > largest and lengths:
            box += [take(s) for s in fullest(lengths, counts, capacity - largest)]
        out.append(box)
    return out


def _pack_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks arrive one after another, each with its items in order."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        for key, rows in batch.groupby(["spec_id", "block"], sort=False):
            if last is not None and key != last:
                yield _packed(pd.concat(held))
                held = []
            last = key
            held.append(rows)
    if held:
        yield _packed(pd.concat(held))


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    capacity = int(rows["capacity"].iloc[0])
    boxes = pack(rows["tokens"].tolist(), capacity)
    at = {place: n for n, box in enumerate(boxes) for place in box}
    return rows.assign(container=[at[i] for i in range(len(rows))])[["spec_id", "block", "container", "doc_id", "piece", "first_token", "tokens"]]


def packing(documents: DataFrame, specs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(spec_id, block, container, doc_id, piece, first_token, tokens): where each piece of each text goes, for each kind.

    documents: a bigint key and a text; specs: spec_id, capacity_tokens. A text
    is one piece unless it is larger than the container. Null and blank texts
    are left out; kinds without a positive capacity hold nothing; repeated texts
    are packed each; an empty table gives an empty result.
    """
    items = documents.select(documents[key].cast("bigint").alias("doc_id"), documents[text].alias("_t"))
    items = items.filter(items["_t"].rlike(NOT_BLANK)).select("doc_id", F.octet_length("_t").cast("bigint").alias("size"))
    kinds = [(r["spec_id"], r["capacity_tokens"]) for r in specs.select("spec_id", "capacity_tokens").collect()]  # a kind each
    kinds = [k for k in kinds if k[1] and k[1] > 0]
    schema = "spec_id bigint, block bigint, container bigint, doc_id bigint, piece bigint, first_token bigint, tokens bigint"
    if not kinds:
        return documents.sparkSession.createDataFrame([], schema)
    blocks = max(1, -(-documents.count() // block))
    each = F.explode(F.array(*[F.struct(F.lit(s).cast("bigint").alias("spec_id"), F.lit(c).cast("bigint").alias("capacity")) for s, c in kinds]))
    pieces = items.select("doc_id", "size", each.alias("k")).select("k.spec_id", "k.capacity", "doc_id", "size")
    pieces = pieces.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / F.col("capacity")))).alias("piece"))
    pieces = pieces.withColumn("first_token", F.col("piece") * F.col("capacity"))
    pieces = pieces.withColumn("tokens", F.least(F.col("capacity"), F.col("size") - F.col("first_token")))
    full = pieces.filter("tokens = capacity").select("spec_id", (-1 - F.col("piece")).cast("bigint").alias("block"), F.col("doc_id").alias("container"), "doc_id", "piece", "first_token", "tokens")
    rest = pieces.filter("tokens < capacity").withColumn("block", F.pmod(F.xxhash64("doc_id", "spec_id"), F.lit(blocks)))
    rest = rest.select("spec_id", "block", "capacity", "doc_id", "piece", "first_token", "tokens").repartition("spec_id", "block").sortWithinPartitions("spec_id", "block", "doc_id", "piece")
    return full.unionByName(rest.mapInPandas(_pack_blocks, schema))


def cut_texts(plan: DataFrame) -> DataFrame:
    """(spec_id, doc_id): the texts that a plan cuts."""
    return plan.filter("piece > 0").select("spec_id", "doc_id").distinct()


def least_containers(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """A number of containers below which no packing can go, whatever the method.

    For every bound a: items over capacity - a stand alone; those over half the
    capacity need a container each; what items from a to half the capacity
    exceed the room beside the latter needs containers of its own.
    """
    order = np.argsort(sizes)
    s, n = sizes[order].astype(np.int64), counts[order].astype(np.int64)
    items, tokens = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(n * s)))
    half = np.searchsorted(s, capacity // 2, side="right")
    bounds = np.concatenate(([0], s[:half]))
    alone = np.searchsorted(s, capacity - bounds, side="right")
    alone = np.maximum(alone, half)
    first = np.searchsorted(s, bounds, side="left")
    large, room = items[-1] - items[half], (items[alone] - items[half]) * capacity - (tokens[alone] - tokens[half])
    more = -((room - (tokens[half] - tokens[first])) // capacity)
    return int(large + np.maximum(more, 0).max(initial=0)) if len(s) else 0


def unused_room(plan: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, containers, least_containers, tokens, unused_share) for each kind of a plan; no packing needs fewer than least_containers."""
    # Pieces by size: at most as many rows for a kind as its capacity has tokens.
    sizes = plan.join(specs.select("spec_id", F.col("capacity_tokens").alias("capacity")), "spec_id").groupBy("spec_id", "capacity", "tokens").agg(F.count("*").alias("pieces"))

    def bound(rows: pd.DataFrame) -> pd.DataFrame:
        least = least_containers(rows["tokens"].to_numpy(), rows["pieces"].to_numpy(), int(rows["capacity"].iloc[0]))
        return pd.DataFrame({"spec_id": [rows["spec_id"].iloc[0]], "least_containers": [least]})

    least = sizes.groupBy("spec_id").applyInPandas(bound, "spec_id bigint, least_containers bigint")
    boxes = plan.groupBy("spec_id", "block", "container").agg(F.sum("tokens").alias("tokens"))
    kinds = boxes.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    room = F.col("containers") * F.col("capacity_tokens")
    joined = kinds.join(specs.select("spec_id", "capacity_tokens"), "spec_id").join(least, "spec_id")
    return joined.select("spec_id", "containers", "least_containers", "tokens", F.round(1 - F.col("tokens") / room, 6).alias("unused_share"))
