"""Subject areas of documents, one, several or none for each.

A bounded sample of labelled documents trains the model on the driver. Terms
(runs of two to four ideographs, words and word pairs) get a subject from the
sentences in which they stand; a sentence deals with the subject that its terms
favour. The features of a document are, for each subject, the share of its
sentences (term features), its source, and its length in sentences (structure).
A chain of logistic classifiers, one for each subject in order of frequency,
sees these and the labels given before it, and so learns which subjects go
together; a beam search decodes the likeliest combination of labels from the
calibrated probabilities.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.textform import canonical

#: Labelled documents used at most, the first by a hash of their id.
SAMPLE = 2_000
#: Bytes that their texts have together at most; the driver holds them.
SAMPLE_BYTES = 64 << 20
#: Documents a term needs, the share of its sentences in documents of its subject, and its gain in odds over the subject's rate.
TERM_DOCS, TERM_SHARE, TERM_GAIN = 3, 0.55, 3.0
#: Share of a document's sentences from which a subject counts.
LEAST_SHARE = 1 / 6
#: Combinations kept at each link of the chain.
BEAM = 8

_END = re.compile(r"[。！？!?]+[”’\"')）】»]*|\.(?=\s+[A-Z«“\"(一-鿿]|\s*$|[一-鿿])")
_HAN = re.compile("[一-鿿]+")
_WORD = re.compile("[a-zà-ɏ]+(?:-[a-z]+)*")


def sentences(text: str) -> list[str]:
    """Sentences of a text in consistent form; line breaks don't end one."""
    text = re.sub(r"(?<=[a-z,;0-9])\s*\n\s*(?=[A-Za-z0-9(])", " ", text).replace("\n", "")
    out, at = [], 0
    for m in _END.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    out.append(text[at:])
    return [x for x in out if len(x.strip()) > 3]


def _divergence(p: float, q: float) -> float:
    """Kullback-Leibler divergence of two coins."""
    return p * np.log(p / q) + ((1 - p) * np.log((1 - p) / (1 - q)) if p < 1 else 0.0)


def terms(sentence: str) -> set[str]:
    out: set[str] = set()
    low = sentence.lower()
    for m in _HAN.finditer(low):
        run = m.group()
        for n in (2, 3, 4):
            out.update(run[i : i + n] for i in range(len(run) - n + 1))
    words = _WORD.findall(low)
    out.update(f" {w} " for w in words if len(w) > 2)
    out.update(f" {a} {b} " for a, b in zip(words, words[1:], strict=False))
    return out


class Lexicon:
    """Subjects of terms, and sentences scored by them."""

    def __init__(self, weights: dict[str, tuple[int, float]], subjects: int) -> None:
        self.weights, self.subjects = weights, subjects
        self._find = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_find": None}  # each worker builds its own matcher

    @classmethod
    def learn(cls, docs: list[list[str]], labels: np.ndarray) -> Lexicon:
        """docs: the sentences of each document; labels: documents x subjects.

        First round: terms by the labels of their documents. Second round: terms
        by the sentences that the first round gives a subject which the document
        has; that leaves out what only happens to stand in such documents.
        """
        found = [[terms(x) for x in d] for d in docs]
        n_docs, n_subjects = labels.shape
        rate = np.maximum(labels.mean(0), 1e-3) if n_docs else np.zeros(n_subjects)
        in_docs: Counter = Counter()
        by_subject: dict = defaultdict(lambda: np.zeros(n_subjects))
        for doc, row in zip(found, labels, strict=True):
            for t in set().union(*doc) if doc else ():
                in_docs[t] += 1
                by_subject[t] += row
        evidence = np.log(len(in_docs) + 1) + 2
        first = {}
        for t, n in in_docs.items():
            if n >= TERM_DOCS:
                hits = by_subject[t]
                s = int((hits / n - rate).argmax())
                share = hits[s] / n
                if share >= TERM_SHARE and share * (1 - rate[s]) >= TERM_GAIN * rate[s] * (1 - share) and n * _divergence(share, rate[s]) >= evidence:
                    first[t] = (s, share)
        in_sentences: Counter = Counter()
        in_docs = Counter()
        by_subject = defaultdict(lambda: np.zeros(n_subjects))
        for doc, row in zip(found, labels, strict=True):
            seen: set[str] = set()
            for sentence in doc:
                score = np.zeros(n_subjects)
                for t in sentence & first.keys():
                    score[first[t][0]] += first[t][1]
                best = int(score.argmax())
                given = best if score[best] >= 1 and score[best] >= 0.6 * score.sum() and row[best] else -1
                if given < 0 and score[best] >= 1:
                    continue  # passing mention or wrong label: says nothing
                in_sentences.update(sentence)
                if given >= 0:
                    for t in sentence:
                        by_subject[t][given] += 1
                    seen |= sentence
            in_docs.update(seen)
        weights = {}
        for t, hits in by_subject.items():
            s = int(hits.argmax())
            share = hits[s] / in_sentences[t]
            if in_docs[t] >= TERM_DOCS and share >= 0.8:
                weights[t] = (s, float(share))
        return cls(weights, n_subjects)

    def _matcher(self):
        try:
            import ahocorasick

            trie = ahocorasick.Automaton()
            for t, value in self.weights.items():
                trie.add_word(t, value)
            if not self.weights:
                return lambda text: iter(())
            trie.make_automaton()
            return trie.iter
        except ImportError:
            def find(text: str):
                for size in {len(t) for t in self.weights}:
                    for i in range(len(text) - size + 1):
                        if text[i : i + size] in self.weights:
                            yield i + size - 1, self.weights[text[i : i + size]]

            return find

    def shares(self, parts: list[str]) -> tuple[np.ndarray, int]:
        """For each subject the number of sentences that deal with it, and the number of sentences."""
        if self._find is None:
            self._find = self._matcher()
        counts = np.zeros(self.subjects)
        for part in parts:
            score: dict[int, float] = {}
            low = part.lower()
            if not _HAN.search(low):
                low = " " + " ".join(_WORD.findall(low)) + " "
            elif re.search("[a-z]{3}", low):
                low = re.sub(r"[a-zà-ɏ]+(?:-[a-z]+)*", r" \g<0> ", low)
            for _, (s, w) in self._find(low):
                score[s] = score.get(s, 0.0) + w
            if score:
                best = max(score, key=score.get)
                if score[best] >= 1.0 and score[best] >= 0.6 * sum(score.values()):
                    counts[best] += 1
        return counts, len(parts)


def _logistic(x: np.ndarray, y: np.ndarray, towards: np.ndarray, ridge: float) -> np.ndarray:
    """Weights by Newton steps, drawn towards given weights."""
    w = towards.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * (w - towards))
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _features(counts: np.ndarray, n: np.ndarray, own: int, source_rate: np.ndarray) -> np.ndarray:
    """Features of one subject for each document: its share, the others, source and structure."""
    share = counts / np.maximum(n, 1)[:, None]
    mine = share[:, own]
    rest = np.delete(share, own, axis=1)
    top = rest.max(axis=1) if rest.shape[1] else np.zeros(len(n))
    return np.column_stack((np.ones(len(n)), np.minimum(mine, 0.5), mine >= LEAST_SHARE - 1e-9, np.clip((mine - LEAST_SHARE) * 8, -1, 1), top, np.log1p(n) / 4, source_rate)).astype(float)


class Chain:
    """Classifiers in a chain over the subjects, most frequent first.

    Calibrated by Platt scaling of all links together, on documents that the
    scaled chain was not fitted on: each half's from a chain of the other half.
    """

    def __init__(self, counts: np.ndarray, n: np.ndarray, sources: list, labels: np.ndarray, calibrated: bool = True) -> None:
        self.order = list(np.argsort(-labels.sum(0), kind="stable"))
        k = labels.shape[1]
        rows = defaultdict(list)
        for i, s in enumerate(sources):
            rows[s].append(i)
        base = labels.mean(0)
        self.base = np.log((base + 0.01) / (1.01 - base))
        self.source = {s: np.log(((labels[i].sum(0) + 5 * base) / (len(i) + 5) + 0.01) / (base + 0.01)) for s, i in rows.items()}
        pooled_x = np.concatenate([self._inputs(counts, n, sources, s, labels, []) for s in range(k)])
        pooled = _logistic(pooled_x, labels.T.ravel(), np.zeros(pooled_x.shape[1]), 1.0)
        self.weights = []
        for at, s in enumerate(self.order):
            x = self._inputs(counts, n, sources, s, labels, self.order[:at])
            towards = np.concatenate((pooled, np.zeros(x.shape[1] - len(pooled))))
            self.weights.append(_logistic(x, labels[:, s], towards, 8.0))
        self.scale = np.array([0.0, 1.0])
        if calibrated and len(n) > 40:
            half = np.arange(len(n)) % 2 == 0
            z, y = [], []
            for own in (half, ~half):
                pick = lambda side: (counts[side], n[side], [s for s, x in zip(sources, side, strict=True) if x], labels[side])
                other = Chain(*pick(~own), calibrated=False)
                z.append(other.links(*pick(own)))
                y += [labels[own][:, s] for s in other.order]
            self.scale = _logistic(np.column_stack((np.ones(len(labels) * k), np.concatenate(z))), np.concatenate(y), self.scale, 1.0)

    def links(self, counts: np.ndarray, n: np.ndarray, sources: list, labels: np.ndarray) -> np.ndarray:
        """The log odds of every link, one after another in the order of the chain, given the labels before it."""
        return np.concatenate([self._inputs(counts, n, sources, s, labels, self.order[:at]) @ w for at, (s, w) in enumerate(zip(self.order, self.weights, strict=True))])

    def _inputs(self, counts, n, sources, s, given, before) -> np.ndarray:
        rate = np.array([self.source.get(x, np.zeros(len(self.base)))[s] for x in sources])
        x = _features(counts, n, s, rate)
        return np.column_stack((x, given[:, before])) if len(before) else x

    def decode(self, counts: np.ndarray, n: np.ndarray, sources: list) -> list[list[int]]:
        """The likeliest combination of subjects for each document, by beam search along the chain."""
        docs, k = counts.shape
        beams = np.zeros((docs, 1, k))
        score = np.zeros((docs, 1))
        for at, (s, w) in enumerate(zip(self.order, self.weights, strict=True)):
            own = self._inputs(counts, n, sources, s, beams[:, 0], []) @ w[: len(w) - at]
            z = own[:, None] + beams[:, :, self.order[:at]] @ w[len(w) - at :] if at else np.repeat(own[:, None], beams.shape[1], axis=1)
            z = np.clip(self.scale[0] + self.scale[1] * z, -30, 30)
            yes = beams.copy()
            yes[:, :, s] = 1
            beams = np.concatenate((beams, yes), axis=1)
            score = np.concatenate((score - np.log1p(np.exp(z)), score - np.log1p(np.exp(-z))), axis=1)
            if score.shape[1] > BEAM:
                best = np.argsort(-score, axis=1, kind="stable")[:, :BEAM]
                score = np.take_along_axis(score, best, axis=1)
                beams = np.take_along_axis(beams, best[:, :, None], axis=1)
        top = beams[np.arange(docs), score.argmax(axis=1)]
        return [list(np.flatnonzero(row)) for row in top]


class Model:
    """Lexicon and chain, trained on labelled texts."""

    def __init__(self, texts: list[str], sources: list, labels: list[set[str]], subjects: list[str]) -> None:
        self.subjects = subjects
        y = np.array([[float(s in own) for s in subjects] for own in labels]).reshape(len(texts), len(subjects))
        parts = [sentences(canonical(t)) for t in texts]
        half = np.arange(len(texts)) % 2 == 0
        self.lexicon = Lexicon.learn(parts, y)
        # The chain is fitted on shares that a lexicon of the other half gave, as new documents' are.
        counts, n = np.zeros(y.shape), np.zeros(len(texts))
        for fold in (half, ~half):
            other = Lexicon.learn([p for p, x in zip(parts, ~fold, strict=True) if x], y[~fold]) if len(texts) > 40 else self.lexicon
            for i in np.flatnonzero(fold):
                counts[i], n[i] = other.shares(parts[i])
        self.chain = Chain(counts, n, sources, y) if len(texts) else None

    def label(self, texts: list[str], sources: list) -> list[list[str]]:
        if self.chain is None or not texts:
            return [[] for _ in texts]
        rows = [self.lexicon.shares(sentences(canonical(t))) for t in texts]
        counts, n = np.array([r[0] for r in rows]), np.array([float(r[1]) for r in rows])
        return [[self.subjects[s] for s in own] for own in self.chain.decode(counts, n, sources)]


def _labeller(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch[at : at + 2000]
                given = model.label(list(part["text"]), list(part["source"]))
                rows = [(k, s) for k, own in zip(part["doc_id"], given, strict=True) for s in own]
                yield pd.DataFrame(rows, columns=["doc_id", "subject"])

    return run


def train(documents: DataFrame, labels: DataFrame, subjects: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from at most `sample` labelled documents of at most `sample_bytes` together; repeated labels count once."""
    names = sorted(r[0] for r in subjects.select("subject").distinct().collect())  # the given list of subjects
    own = labels.filter(F.col("subject").isin(names)).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("own"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = documents.select("doc_id", "text", "source").filter(F.col("text").rlike("\\S"))
    labelled = own.join(texts, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id")
    total = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over `sample` rows
    rows = labelled.withColumn("total", total).filter(F.col("total") <= sample_bytes).drop("total").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return Model([r["text"] for r in rows], [r["source"] for r in rows], [set(r["own"]) for r in rows], names)


def subject_areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, subject): the subjects of every document with text, labelled ones included.

    documents: doc_id bigint, text, source; labels: doc_id, subject; subjects:
    subject. Null and blank texts have none; a null source is a source of its
    own; without labels no document has a subject.
    """
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels, subjects, sample))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _labeller(model.value)(batches)

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source").filter(F.col("text").rlike("\\S"))
    return texts.mapInPandas(run, "doc_id bigint, subject string")
