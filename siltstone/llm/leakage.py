"""Evaluation passages that leaked into a corpus.

Each task indexes its documents shard by shard with an FM-index: the suffix
array by prefix doubling, the Burrows-Wheeler transform in a wavelet matrix,
and sampled suffix positions. Every seed of every passage, at every place, is
counted by backward search, all at once. The rarer seeds are located; the most
frequent may be left, since together they cover too little of the passage to
make a case. The documents so found are then compared letter by letter with the
passage, and the runs of both are merged into spans for removal.

The search loses no case that the comparison accepts. A case has runs on `share`
of the passage, and equal pieces of at least a seed's length, which can join in
runs, on at least (1 - CHANGED) * share of it. The seeds left out cover at most
LEFT_OUT of the latter, and a document is compared as soon as located seeds
cover the rest.

No shuffle: the corpus is read once, where it lies. More than BLOCK items are
searched block by block in an index that is built once and kept in the shared
folder.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.textform import canonical
from siltstone.runtime import cut

#: Letters of an index shard: bounds the memory of a task, whatever the partition.
SHARD = 2_000_000
#: Rows between sampled suffix positions.
SAMPLE = 4
#: Items whose seeds are searched at once; more are taken in blocks.
BLOCK = 2_000
#: By language: least run, and length of a seed.
RULES = {"zh": (20, 6), "en": (50, 12)}
#: Letters of a gap between two seeds of one run, and the share of a run that may differ.
GAP, CHANGED = 12, 0.12
#: Part of the letters that a case must show which the seeds left out may cover.
LEFT_OUT = 0.5
#: Bits of a seed's hash that are looked up before the hash itself.
TOP_BITS = 20
#: Occurrences located at once, whole items at a time.
LOCATED = 2_000_000


class FMIndex:
    """Count and locate over a text of symbols 0 .. sigma - 1."""

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        self.n, self.sigma = len(text), sigma
        order = suffix_array(text, sigma)
        self.bwt = text[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma)))).astype(np.int64)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        symbols = self.bwt
        for level in range(self.levels - 1, -1, -1):
            bits = ((symbols >> level) & 1).astype(bool)
            self._add(bits)
            symbols = np.concatenate((symbols[~bits], symbols[bits]))
        marked = order % SAMPLE == 0
        self.mark_words, self.mark_before = _packed(marked)
        self.samples = order[marked].astype(np.int32)
        self.base = self._down(np.arange(sigma), np.zeros(sigma, np.int64))
        # The step from each row to that of the letter before, first[c] + rank(c, row), for all rows at once by counting sort.
        self.back = np.empty(self.n, np.int32)
        self.back[np.argsort(self.bwt.astype(np.uint16) if sigma <= 1 << 16 else self.bwt, kind="stable")] = np.arange(self.n, dtype=np.int32)

    def _add(self, bits: np.ndarray) -> None:
        words, before = _packed(bits)
        self.words.append(words)
        self.before.append(before)
        self.zeros.append(len(bits) - int(bits.sum()))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The place of prefix end i after following `symbol` through the matrix."""
        for depth, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = _rank(self.words[depth], self.before[depth], i)
            i = np.where((symbol >> level) & 1, self.zeros[depth] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first i symbols of the transform."""
        return self._down(symbol, i) - self.base[symbol]

    def search(self, text: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one rows for each pattern text[start : start + size], by backward search; negative symbols match nothing."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64)
        live = np.arange(len(starts))
        for column in range(size - 1, -1, -1):
            c = text[starts[live] + column]
            if (c < 0).any():
                high[live[c < 0]] = low[live[c < 0]]
                live, c = live[c >= 0], c[c >= 0]
            both = self.rank(np.concatenate((c, c)), np.concatenate((low[live], high[live])))
            low[live], high[live] = self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps back to the next sampled one."""
        at, steps, row, todo = np.zeros(len(rows), np.int64), 0, rows.copy(), np.arange(len(rows))
        while len(todo):
            hit = (self.mark_words[row >> 6] >> (row & 63).astype(np.uint64)) & np.uint64(1) == 1
            at[todo[hit]] = self.samples[_rank(self.mark_words, self.mark_before, row[hit])].astype(np.int64) + steps
            todo, row = todo[~hit], self.back[row[~hit]].astype(np.int64)
            steps += 1
        return at % self.n


def _packed(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
    padded[: len(bits)] = bits
    words = np.packbits(padded, bitorder="little").view(np.uint64)
    before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
    return words, before


def _rank(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
    block = i >> 6
    below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
    return before[block] + np.bitwise_count(words[block] & below).astype(np.int64)


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Order of all suffixes by prefix doubling; only groups that are still equal are sorted again."""
    n, bits = len(text), max(1, int(sigma - 1).bit_length())
    size = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(size):
        key <<= bits
        if i < n:
            key[: n - i] |= text[i:]
    order = np.argsort(key)
    ordered = key[order]
    del key
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    slots = np.arange(n)
    start = np.maximum.accumulate(np.where(new, slots, 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    rest = slots[~(new & np.append(new[1:], True))]
    while len(rest):
        at = order[rest]
        ahead = at + size
        # Suffixes that end within the prefix come first, the shortest before the others.
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + n + 1, n - at)
        key = rank[at] * (2 * n + 2) + second
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[rest] = at
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = rest[np.maximum.accumulate(np.where(new, np.arange(len(rest)), 0))]
        rest = rest[~(new & np.append(new[1:], True))]
        size *= 2
    return order


_LETTER: np.ndarray | None = None
_PLANES = 0x110000


def _letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of letters and digits of a text, lower case, and their places."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalnum() for i in range(_PLANES)), bool, _PLANES)
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    places = np.flatnonzero(_LETTER[codes])
    return codes[places].astype(np.int32), places


def _rule(codes: np.ndarray) -> str:
    return "zh" if len(codes) and (codes >= 0x3400).sum() * 3 >= len(codes) else "en"


class Group:
    """The passages of one language, one after another, and every place where a seed begins."""

    def __init__(self, numbers: list[int], passages: list[np.ndarray], size: int, least: int) -> None:
        self.size, self.least = size, least
        self.text = np.concatenate(passages)
        lengths = np.array([len(x) for x in passages])
        self.begin = np.concatenate(([0], np.cumsum(lengths)))
        self.number = np.array(numbers)
        at = np.arange(len(self.text))
        self.of = np.repeat(np.arange(len(passages)), lengths)
        self.starts = at[at + size <= self.begin[1:][self.of]]
        hashes = _hashes(self.text, size)[self.starts]
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.hashed = hashes[order], self.starts[order]
        self.tops = np.zeros(1 << TOP_BITS, bool)  # first bits that some seed's hash has
        self.tops[_top(hashes)] = True

    def rare(self, counts: np.ndarray, left: float) -> np.ndarray:
        """Which seeds to locate: those at most as frequent as the bound of their passage.

        A letter's frequency is that of the most frequent seed over it. The seeds
        above the bound cover only letters above it, at most `left` of the passage.
        """
        seed = np.zeros(len(self.text), np.int64)
        seed[self.starts] = counts
        frequency = seed.copy()
        for i in range(1, self.size):
            np.maximum(frequency[i:], seed[:-i], out=frequency[i:])
        order = np.lexsort((-frequency, self.of))
        allowed = np.floor(left * np.diff(self.begin)).astype(np.int64)
        bound = frequency[order][self.begin[:-1] + np.minimum(allowed, np.diff(self.begin) - 1)]
        return (counts > 0) & (counts <= bound[self.of[self.starts]])


class Items:
    """The passages of a block of items, with their seeds for search and for comparison."""

    def __init__(self, items: pd.DataFrame, share: float) -> None:
        self.ids, self.codes, rules = [], [], []
        for key, text in zip(items["item_id"], items["passage"], strict=True):
            codes, _ = _letters(canonical(text) if text else "")
            if len(codes):
                self.ids.append(key)
                self.codes.append(codes)
                rules.append(_rule(codes))
        self.share = share
        shown = (1 - CHANGED) * share
        self.left, self.need = LEFT_OUT * shown, (1 - LEFT_OUT) * shown
        self.groups = []
        for lang, (least, size) in RULES.items():
            own = [i for i, r in enumerate(rules) if r == lang and len(self.codes[i]) >= size]
            if own:
                self.groups.append(Group(own, [self.codes[i] for i in own], size, least))

    def promising(self, index: FMIndex, symbol: np.ndarray, ends: np.ndarray) -> list[tuple[Group, np.ndarray, np.ndarray]]:
        """By group: documents, in order, and the item in the group of which located seeds cover the share that a case must show."""
        out = []
        for group in self.groups:
            low, high = index.search(symbol[group.text], group.starts, group.size)
            keep = np.flatnonzero(group.rare(high - low, self.left))
            # Whole items together, up to LOCATED occurrences at once.
            upto = np.cumsum((high - low)[keep])
            last = np.flatnonzero(np.append(np.diff(group.of[group.starts[keep]]), 1)) + 1
            parts = np.split(keep, last[np.flatnonzero(np.diff(upto[last - 1] // LOCATED))]) if len(keep) else []
            found = [self._covering(index, group, ends, part, low[part], (high - low)[part]) for part in parts]
            doc, item = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            order = np.lexsort((item, doc))
            out.append((group, doc[order], item[order]))
        return out

    def _covering(self, index: FMIndex, group: Group, ends: np.ndarray, seeds: np.ndarray, low: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) of which some seeds, given by their rows, cover enough; seeds in the order of the text."""
        rows, which = np.unique(low, return_inverse=True)  # equal seeds have equal rows, and are located once
        size = np.zeros(len(rows), np.int64)
        size[which] = counts
        begin = np.cumsum(size) - size
        doc = np.searchsorted(ends, index.locate(np.repeat(rows - begin, size) + np.arange(size.sum())), side="right").astype(np.uint16 if len(ends) < 1 << 16 else np.int32)
        doc = doc[np.repeat(begin[which] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
        start = np.repeat(group.starts[seeds], counts)
        order = np.argsort(doc, kind="stable")  # by document, then in the order of the text
        doc, start = doc[order].astype(np.int64), start[order]
        new = np.concatenate((np.ones(min(1, len(doc)), bool), (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])))
        doc, start = doc[new], start[new]
        item = group.of[start]
        head = np.concatenate((np.ones(min(1, len(doc)), bool), (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
        gain = np.where(head, group.size, np.minimum(group.size, np.diff(start, prepend=0)))
        first = np.flatnonzero(head)
        enough = np.add.reduceat(gain, first) >= self.need * np.diff(group.begin)[item[first]] if len(first) else np.zeros(0, bool)
        return doc[first][enough], item[first][enough]


def _top(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TOP_BITS)).astype(np.int64)


def _hashes(codes: np.ndarray, size: int) -> np.ndarray:
    n = len(codes) - size + 1
    total = np.zeros(max(n, 0), np.uint64)
    for i in range(size if n > 0 else 0):
        total = total * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n].astype(np.uint64)
    return total


def _segments(letters: np.ndarray, group: Group, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
    """(item in the group, place in its passage, place in the document, letters) of all maximal equal pieces of at least a seed.

    Of a document and the wanted items; by item, in the order of the document.
    """
    seeds = _hashes(letters, group.size)
    at = np.flatnonzero(group.tops[_top(seeds)])
    seeds = seeds[at]
    low = np.searchsorted(group.hashes, seeds, side="left")
    same = group.hashes[np.minimum(low, len(group.hashes) - 1)] == seeds
    at, low, seeds = at[same], low[same], seeds[same]
    counts = np.searchsorted(group.hashes, seeds, side="right") - low
    start = group.hashed[np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
    asked = np.zeros(len(group.number), bool)
    asked[wanted] = True
    own = np.flatnonzero(asked[group.of[start]])
    start, at = start[own], np.repeat(at, counts)[own]
    # Seeds of one piece lie on one diagonal, one letter apart.
    order = np.lexsort((at, start - at, group.of[start]))
    start, at = start[order], at[order]
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), (np.diff(at) != 1) | (np.diff(start) != 1) | (group.of[start[1:]] != group.of[start[:-1]]))))
    length = np.diff(np.append(head, len(at))) + group.size - 1
    start, at = start[head], at[head]
    item = group.of[start]
    order = np.lexsort((start, at, item))
    item, start = item[order], start[order]
    return item, start - group.begin[item], at[order], length[order]


def _joining(item: np.ndarray, j: np.ndarray, at: np.ndarray, length: np.ndarray, group: Group) -> np.ndarray:
    """Which pieces can be part of a run: long enough by themselves, or with one that goes on from them or they from it."""
    joins = length >= group.least
    key = item.astype(np.int64) * (int(at.max(initial=0)) + int(length.max(initial=0)) + GAP + 1) + at
    last = np.searchsorted(key, key + length + GAP, side="right")
    a, step = np.arange(len(key)), 1
    while len(a := a[a + step < last[a]]):
        b = a + step
        dj, di = j[b] - j[a] - length[a], at[b] - at[a] - length[a]
        linked = (dj > -group.size) & (dj <= GAP) & (di > -group.size) & (np.abs(dj - di) <= 3)
        joins[a[linked]] = joins[b[linked]] = True
        step += 1
    return joins


def _enough(item: np.ndarray, j: np.ndarray, length: np.ndarray, group: Group, wanted: np.ndarray, share: float) -> np.ndarray:
    """The wanted items of which pieces cover at least `share`."""
    order = np.lexsort((j, item))
    item, begin, end = item[order], j[order], (j + length)[order]
    base = item.astype(np.int64) * (int(np.diff(group.begin).max()) + 1)
    reach = np.concatenate(([0], np.maximum.accumulate(base + end)[:-1])) - base
    new = np.maximum(0, end - np.maximum(begin, np.maximum(reach, 0)))
    covered = np.bincount(item, weights=new, minlength=len(group.number))
    return wanted[covered[wanted] >= share * np.diff(group.begin)[wanted]]


def runs(pieces: list[tuple[int, int, int]], seed: int, least: int) -> list[tuple[int, int, int, int]]:
    """(passage start, end, document start, end) of the runs that equal pieces (passage, document, letters) form, of at least `least` letters.

    A run may hold changed, added or missing letters where both sides go on. A
    chain of pieces in which too much differs is taken apart into its runs.
    """
    # Pieces in the order of the document; each joins the chain that it continues.
    open_chains: list[list[tuple[int, int, int, int, int]]] = []  # passage start, end, document start, end, letters new
    done = []
    for j, i, n in pieces:
        best, nearest = None, None
        for chain in open_chains:
            _, end, _, to, _ = chain[-1]
            dj, di = j - end, i - to
            if -seed < dj <= GAP and -seed < di <= GAP and abs(dj - di) <= 3 and (dj == di or min(dj, di) >= -2) and j + n > end and i + n > to and (best is None or abs(dj - di) < nearest):
                best, nearest = chain, abs(dj - di)
        if best is None:
            open_chains.append([(j, j + n, i, i + n, n)])
        else:
            best.append((j, j + n, i, i + n, min(n, j + n - best[-1][1], i + n - best[-1][3])))
        if len(open_chains) > 16:
            done += [c for c in open_chains if i - c[-1][3] > GAP]
            open_chains = [c for c in open_chains if i - c[-1][3] <= GAP]
    out: list[tuple[int, int, int, int]] = []
    todo = done + open_chains
    while todo:
        chain = todo.pop()
        if chain[-1][1] - chain[0][0] < least:
            continue
        first, last = _longest_alike(chain)
        a, b, c, d = chain[first][0], chain[last][1], chain[first][2], chain[last][3]
        if b - a >= least:
            out.append((a, b, c, d))
            todo += [x for x in (chain[:first], chain[last + 1 :]) if x]
    return out


def _longest_alike(chain: list[tuple[int, int, int, int, int]]) -> tuple[int, int]:
    """First and last piece of the longest part of a chain in which at most CHANGED of the letters differ."""
    need = 1 - CHANGED
    matched = list(itertools.accumulate(x[4] for x in chain))
    # The part from piece k to piece m is alike if value[m] >= bound[k].
    value = [matched[m] - need * x[1] for m, x in enumerate(chain)]
    bound = [matched[k] - (x[1] - x[0]) - need * x[0] for k, x in enumerate(chain)]
    # A start is of use only if its bound is below those of all earlier ones; the lower the bound, the farther the end.
    starts = [k for k, (b, low) in enumerate(zip(bound, itertools.accumulate([math.inf, *bound], min), strict=False)) if b < low]
    best, m = (0, 0, 0), len(chain) - 1
    for k in reversed(starts):
        while m > k and value[m] < bound[k] - 1e-9:
            m -= 1
        if m >= k:
            best = max(best, (chain[m][1] - chain[k][0], k, m))
    return best[1], best[2]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _indexed(docs: list[np.ndarray]) -> tuple[FMIndex, np.ndarray, np.ndarray]:
    """The index of a shard, the symbol of each code (-1 where the shard has none), and the ends of its documents."""
    ends = np.cumsum([len(c) + 1 for c in docs])
    # The end of the text has a symbol of its own, below the one that parts documents, so that steps back never lead astray.
    codes = np.ones(ends[-1] + 1, np.int32)
    codes[-1] = 0
    for c, end in zip(docs, ends, strict=True):
        codes[end - 1 - len(c) : end - 1] = c
    present = np.zeros(_PLANES, bool)
    present[codes] = True
    symbol = np.where(present, np.cumsum(present) - 1, -1).astype(np.int32)
    return FMIndex(symbol[codes], int(present.sum())), symbol, ends


def _compared(docs: list[tuple[int, np.ndarray, np.ndarray]], near: list[tuple[Group, np.ndarray, np.ndarray]], items: Items) -> pd.DataFrame:
    """The cases among documents and items that are near."""
    out = []
    for group, doc, item in near:
        firsts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else []
        for d, wanted in zip(doc[firsts], np.split(item, firsts[1:]), strict=True) if len(doc) else ():
            if d < len(docs):
                out += _cases(docs[d], group, wanted, items)
    return pd.DataFrame(out, columns=_COLUMNS)


def _cases(doc: tuple[int, np.ndarray, np.ndarray], group: Group, wanted: np.ndarray, items: Items) -> Iterator[tuple]:
    """(key, item_id, covered, spans) of the wanted items that are cases in a document."""
    key, letters, places = doc
    item, j, at, length = _segments(letters, group, wanted)
    joins = _joining(item, j, at, length, group)
    item, j, at, length = item[joins], j[joins], at[joins], length[joins]
    for i in _enough(item, j, length, group, wanted, (1 - CHANGED) * items.share):
        whole = int(group.begin[i + 1] - group.begin[i])
        own = slice(*np.searchsorted(item, (i, i + 1)))
        common = runs(list(zip(j[own].tolist(), at[own].tolist(), length[own].tolist(), strict=True)), group.size, group.least)
        covered = sum(y - x for x, y in _merged([(x, y) for x, y, _, _ in common]))
        if covered >= items.share * whole:
            spans = [(int(places[x]), int(places[y - 1]) + 1) for x, y in _merged([(x, y) for _, _, x, y in common])]
            yield key, items.ids[group.number[i]], covered / whole, spans


_COLUMNS = ["doc_id", "item_id", "covered", "spans"]
FOUND = "doc_id bigint, item_id bigint, covered double, spans array<struct<start: bigint, end: bigint>>"


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """(key, letters, places) of the documents with letters, SHARD letters at a time."""
    docs, held = [], 0
    for batch in batches:
        for key, text in zip(batch["doc_id"], batch["text"], strict=True):
            letters, places = _letters(canonical(text))
            if not len(letters):
                continue
            docs.append((key, letters, places.astype(np.int32)))
            held += len(letters) + 1
            if held >= SHARD:
                yield docs
                docs, held = [], 0
    if docs:
        yield docs


def _searcher(block: pd.DataFrame, share: float):
    """Builds the index of each shard and searches it for one block of items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = Items(block, share)
        for docs in _shards(batches):
            near = items.promising(*_indexed([c for _, c, _ in docs]))
            yield _compared(docs, near, items)

    return run


def _builder(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for docs in _shards(batches):
        yield pd.DataFrame({"shard": [pickle.dumps((docs, *_indexed([c for _, c, _ in docs])), protocol=5)]})


def index(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(shard binary): the FM-index of each shard with its documents' letters, as a table in the shared folder.

    For several searches of one corpus; about 5 bytes a letter.
    """
    docs = documents.select(documents[key].cast("bigint").alias("doc_id"), documents[text].alias("text")).filter("text is not null")
    return cut(docs.mapInPandas(_builder, "shard binary"), "fm-index")


def _index_searcher(block: pd.DataFrame, share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = Items(block, share)
        for batch in batches:
            for shard in batch["shard"]:
                docs, *built = pickle.loads(shard)
                yield _compared(docs, items.promising(*built), items)

    return run


def _blocks(items: DataFrame) -> Iterator[pd.DataFrame]:
    stated = items.select(F.col("item_id").cast("bigint").alias("item_id"), "passage").filter("passage is not null").orderBy("item_id")
    rows = stated.toLocalIterator(prefetchPartitions=False)
    while block := [r for _, r in zip(range(BLOCK), rows)]:
        yield pd.DataFrame(block, columns=["item_id", "passage"])


def search_index(shards: DataFrame, items: DataFrame, share: float = 0.5) -> DataFrame:
    """As leaked_items, in a table that `index` made: one pass over the index for each block of items, none over the texts."""
    out = None
    for block in _blocks(items):
        found = shards.mapInPandas(_index_searcher(block, share), FOUND)
        out = found if out is None else out.unionByName(found)
    return shards.sparkSession.createDataFrame([], FOUND) if out is None else out


def leaked_items(documents: DataFrame, key: str, text: str, items: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id, item_id, covered, spans): documents with at least `share` of an item's passage.

    items: (item_id bigint, passage string), the stated query set, which goes to
    the tasks in blocks of BLOCK. One block is searched as the corpus is read;
    for more, the index is built once and kept. spans are the places to remove in
    the consistent form of the text. Null and blank texts and passages never
    count; repeated documents are reported each; a document as long as several
    shards is indexed whole; passages shorter than a seed are never found.
    """
    blocks = _blocks(items)
    first, more = next(blocks, None), next(blocks, None)
    if more is not None:
        return search_index(index(documents, key, text), items, share)
    docs = documents.select(documents[key].cast("bigint").alias("doc_id"), documents[text].alias("text")).filter("text is not null")
    block = pd.DataFrame({"item_id": [], "passage": []}) if first is None else first
    return docs.mapInPandas(_searcher(block, share), FOUND)
