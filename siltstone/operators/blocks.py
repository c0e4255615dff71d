"""The best chunks of many bags of terms, chunk by chunk in blocks: scores of pairs never leave their task.

Bags share most of their terms. Terms that stand side by side in many bags are
added up once for each block, as a symbol of their own, so that a bag is the sum of few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bags that must share two neighbouring symbols before these become one.
SHARED = 8
#: Bytes of the rows of all symbols in a block, and scores held at once.
ROW_BYTES, SCORES = 48 << 20, 1 << 17
#: Scores are rounded to six digits; what may round up to a limit lies above the limit less this.
SLACK = 1e-6
#: Least limit of a bag of positive weights: any score above 0 is a match.
ABOVE_0 = np.nextafter(0.0, 1.0)
#: Parts of a block whose maxima give a first limit.
PARTS = 32


class Bags(NamedTuple):
    """terms, idf: by term; term, times: of each symbol that is one term; rounds: the symbols
    that each further symbol adds up; groups: bags of equally many symbols, and these;
    start, parts: the terms of each bag; positive: whether all its weights are."""

    own: np.ndarray
    terms: list[str]
    idf: np.ndarray
    term: np.ndarray
    times: np.ndarray
    rounds: list[tuple[np.ndarray, np.ndarray]]
    groups: list[tuple[np.ndarray, np.ndarray]]
    start: np.ndarray
    parts: np.ndarray
    positive: np.ndarray


def bags(own: np.ndarray, stated: pa.Array, idf: dict[str, float], shared: int = SHARED) -> Bags:
    """stated: each bag as `term:times` with blanks between; own: a number for each."""
    lists = pc.split_pattern(stated, " ")
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = [s.rsplit(":", 1) for s in coded.dictionary.to_pylist()]
    at: dict[str, int] = {}
    term = np.array([at.setdefault(t, len(at)) for t, _ in pairs], np.int64)
    times = np.array([float(n) for _, n in pairs])
    weight = np.array([idf[t] for t in at])
    bag = np.repeat(np.arange(len(own)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    start = np.searchsorted(bag, np.arange(len(own) + 1))
    parts = term[code]
    positive = np.minimum.reduceat(weight[parts], start[:-1]) > 0 if len(own) else np.zeros(0, bool)
    # Frequent terms first: those of one turn of phrase are about equally frequent and come to stand side by side.
    used = np.bincount(code, minlength=len(pairs))
    code = code[np.lexsort((code, -used[code], bag))]
    n, rounds = len(pairs), []
    while True:
        near = np.flatnonzero(bag[1:] == bag[:-1])
        pair = code[near] * n + code[near + 1]
        keys, place, count = np.unique(pair, return_inverse=True, return_counts=True)
        # Of overlapping pairs the one that more bags share; equal ones by number.
        rank = np.zeros(len(code) + 1, np.int64)
        rank[near + 1] = np.where(count[place] >= shared, count[place] * len(keys) + place + 1, 0)
        first = np.flatnonzero((rank[1:-1] > rank[:-2]) & (rank[1:-1] > rank[2:]))
        made = code[first] * n + code[first + 1]
        keys, place, count = np.unique(made, return_inverse=True, return_counts=True)
        enough = count >= shared
        if not enough.any():
            break
        first, place = first[enough[place]], (np.cumsum(enough) - 1)[place[enough[place]]]
        code[first] = n + place
        kept = np.ones(len(code), bool)
        kept[first + 1] = False
        code, bag = code[kept], bag[kept]
        rounds.append((keys[enough] // n, keys[enough] % n))
        n += int(enough.sum())
    size, begin = np.bincount(bag, minlength=len(own)), np.searchsorted(bag, np.arange(len(own)))
    groups = [(who := np.flatnonzero(size == m), code[begin[who][:, None] + np.arange(m)]) for m in np.unique(size) if m]
    return Bags(own, list(at), weight, term, times, rounds, groups, start, parts, positive)


def rounded(x: np.ndarray) -> np.ndarray:
    """To six digits, halves away from 0."""
    return np.trunc(x * 1e6 + np.copysign(0.5, x)) / 1e6


class _Best:
    """The k best chunks so far of each bag, ties by key, and the least score that can still change them."""

    def __init__(self, b: Bags, k: int):
        self.k, self.floor = k, np.where(b.positive, ABOVE_0, -np.inf)
        self.score, self.key = np.full((len(b.own), k), -np.inf), np.zeros((len(b.own), k), np.int64)
        self.limit = self.floor.copy()

    def add(self, bag: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        met = np.unique(bag)
        bags = np.concatenate((np.repeat(met, self.k), bag))
        keys, scores = np.concatenate((self.key[met].ravel(), key)), np.concatenate((self.score[met].ravel(), rounded(score)))
        order = np.lexsort((keys, -scores, bags))
        bags = bags[order]
        place = np.arange(len(bags)) - np.searchsorted(bags, met).repeat(np.bincount(np.searchsorted(met, bags), minlength=len(met)))
        best = order[place < self.k]
        self.key[met], self.score[met] = keys[best].reshape(-1, self.k), scores[best].reshape(-1, self.k)
        self.limit[met] = np.maximum(self.score[met, -1] - SLACK, self.floor[met])


def best(b: Bags, k: int, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Maps (key, length, terms, tfs) to (own, key, score): the k best chunks of all batches for each bag.

    part: what a term of idf 1 adds, by its count in the chunk and the chunk's length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, single = _Best(b, k), len(b.term)
        symbols = single + sum(len(x) for x, _ in b.rounds)
        width = int(np.clip(ROW_BYTES // (8 * symbols), 256, 4096))
        step = max(1, SCORES // width)
        rows, sums, more = np.empty(symbols * width), np.empty(step * width), np.empty(step * width)
        vocabulary, odd = pa.array(b.terms, pa.string()), not b.positive.all()

        def block(code: np.ndarray, doc: np.ndarray, value: np.ndarray, keys: np.ndarray) -> None:
            n = len(keys)
            c = rows[: symbols * n].reshape(-1, n)
            one = np.zeros((len(b.terms), n))
            one[code, doc] = value
            np.multiply(one[b.term], b.times[:, None], out=c[:single])
            at = single
            for x, y in b.rounds:
                np.add(c[x], c[y], out=c[at : at + len(x)])
                at += len(x)
            has = np.zeros(one.shape, bool) if odd else None
            if odd:
                has[code, doc] = True
            found = []
            for who, parts in b.groups:
                for s in range(0, len(who), step):
                    bag, p = who[s : s + step], parts[s : s + step]
                    total, other = sums[: len(bag) * n].reshape(-1, n), more[: len(bag) * n].reshape(-1, n)
                    np.take(c, p[:, 0], axis=0, out=total, mode="clip")
                    for j in range(1, p.shape[1]):
                        np.take(c, p[:, j], axis=0, out=other, mode="clip")
                        total += other
                    limit = top.limit[bag]
                    if n >= PARTS >= k and np.isneginf(top.score[bag, -1]).any():
                        # The kth of the maxima of parts: at least k chunks reach it. Above 0 they match.
                        least = np.partition(total[:, : n // PARTS * PARTS].reshape(len(bag), PARTS, -1).max(axis=2), PARTS - k, axis=1)[:, PARTS - k]
                        limit = np.where(least > 0, np.maximum(limit, least - SLACK), limit)
                    row, column = np.divmod(np.flatnonzero(total >= limit[:, None]), n)
                    if len(row):
                        score = total[row, column]
                        if odd:
                            match = _matches(b, has, bag[row], column)
                            row, column, score = row[match], column[match], score[match]
                        found.append((bag[row], keys[column], score))
            if found:
                top.add(*(np.concatenate(x) for x in zip(*found, strict=True)))

        for batch in batches:
            lists = batch.column("terms")
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            coded = lists.flatten().dictionary_encode()
            known = pc.fill_null(pc.index_in(coded.dictionary, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            code = known[coded.indices.to_numpy(zero_copy_only=False)]
            doc = np.repeat(np.arange(len(size)), size)
            of = np.flatnonzero(code >= 0)
            code, doc = code[of], doc[of]
            tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)[of].astype(np.float64)
            value = b.idf[code] * part(tf, batch.column("length").to_numpy(zero_copy_only=False)[doc].astype(np.float64))
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for lo in range(0, len(keys), width):
                i, j = np.searchsorted(doc, (lo, lo + width))
                block(code[i:j], doc[i:j] - lo, value[i:j], keys[lo : lo + width])
        for lo in range(0, len(b.own), 10_000):
            score = top.score[lo : lo + 10_000]
            row, column = np.nonzero(score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(b.own[lo + row]), pa.array(top.key[lo + row, column]), pa.array(score[row, column])], ["own", "key", "score"])

    return run


def _matches(b: Bags, has: np.ndarray, bag: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Whether each bag shares a term with the chunk of the column."""
    size = (b.start[1:] - b.start[:-1])[bag]
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    at = np.arange(size.sum()) - np.repeat(first, size) + np.repeat(b.start[bag], size)
    return np.logical_or.reduceat(has[b.parts[at], np.repeat(column, size)], first)
