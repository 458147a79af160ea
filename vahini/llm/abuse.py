"""Problem 10: abusive, hateful or sexual sentences by FTRL-proximal logistic regression.

Features are hashed word n-grams and skip-grams of a sentence, words in a form that undoes disguises (other case, digits
for letters, drawn-out letters, masks). Labels are on documents, so the model learns from bags: a clean document makes
all its sentences negative, an abusive one makes its most suspicious sentence positive. Per-coordinate rates and L1
leave few weights, which are sent to the workers; a document's score is that of its worst sentence.

The labelled sample is at most ``SAMPLE`` documents (a hash of the id decides), so training is bounded; scoring reads
every document whole.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vahini.session import spread

SAMPLE = 20_000
BITS = 20
EPOCHS = 8
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.1
# Digits and signs used for letters.
DISGUISES = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t"})
_HIDDEN = re.compile("[­​‌‍⁠﻿]")
_END = re.compile(r"(?<=[.!?।])[\"'”’)]*\s+(?=\S)")
_TOKEN = re.compile(r"[\w@$!*+ऀ-ॿ]+")


@lru_cache(300_000)
def normal_word(word: str) -> str:
    if "*" in word:
        return "<masked>"
    word = word.rstrip("!+")
    if word.isdigit():
        return "#"
    if re.search(r"[a-z]", word) and re.search(r"[@$!0-9]", word):
        word = word.translate(DISGUISES)
    return re.sub(r"(.)\1+", r"\1", word)


def sentences(text: str | None) -> list[list[str]]:
    """Words of every sentence; line ends are spaces. Long sentences without stops are cut into overlapping pieces."""
    if not text:
        return []
    s = unicodedata.normalize("NFKC", _HIDDEN.sub("", text)).lower()
    out = []
    for part in _END.split(re.sub(r"\s+", " ", s)):
        words = [w for t in _TOKEN.findall(part) if (w := normal_word(t))]
        if words:
            out += [words[a : a + 40] for a in range(0, max(1, len(words) - 10), 30)] if len(words) > 40 else [words]
    return out


@lru_cache(300_000)
def _code(word: str) -> int:
    return zlib.crc32(word.encode())


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """A hash of whole arrays: n-grams of word codes never become strings."""
    h = np.uint64(0x9E3779B97F4A7C15)
    for p in parts:
        h = (h ^ np.asarray(p, np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(32))
    return h


def features(pieces: list[list[str]], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, pairs, triples and pairs that skip one or two words, of many sentences at once.

    (features, starts): the distinct features of every sentence one after the other, and where each sentence's begin.
    """
    if not pieces:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begin, end = _code("<s>"), _code("</s>")
    words = np.fromiter((c for s in pieces for c in (begin, *map(_code, s), end)), np.uint64)
    at = np.repeat(np.arange(len(pieces)), [len(s) + 2 for s in pieces])
    inner = np.ones(len(words), bool)
    inner[np.flatnonzero(np.diff(at, prepend=-1))] = False
    inner[np.flatnonzero(np.diff(at, append=len(pieces)))] = False
    with np.errstate(over="ignore"):
        made = [(np.arange(len(pieces)), np.broadcast_to(_mixed(0), (len(pieces),))), (at[inner], _mixed(1, words[inner]))]
        for gap in (1, 2, 3):
            same = at[gap:] == at[:-gap]
            made.append((at[gap:][same], _mixed(1 + gap, words[:-gap][same], words[gap:][same])))
        same = at[2:] == at[:-2]
        made.append((at[2:][same], _mixed(5, words[:-2][same], words[1:-1][same], words[2:][same])))
    keys = np.concatenate([(i.astype(np.int64) << bits) | (h >> np.uint64(64 - bits)).astype(np.int64) for i, h in made])
    keys.sort()
    keys = keys[np.flatnonzero(np.diff(keys, prepend=-1))]
    owner = keys >> bits
    return keys & ((1 << bits) - 1), np.searchsorted(owner, np.arange(len(pieces)))


def bag(text: str | None) -> list[np.ndarray]:
    """The features of each sentence of a document."""
    x, starts = features(sentences(text))
    return np.split(x, starts[1:]) if len(starts) else []


class Ftrl:
    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, x: np.ndarray) -> np.ndarray:
        z, n = self.z[x], self.n[x]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def scores(self, bag: list[np.ndarray]) -> np.ndarray:
        n = np.array([len(x) for x in bag])
        return np.add.reduceat(self.weights(np.concatenate(bag)), np.cumsum(n) - n) / np.sqrt(n)

    def learn(self, x: np.ndarray, y: int) -> None:
        w = self.weights(x)
        norm = np.sqrt(len(x))
        p = 1 / (1 + np.exp(-np.clip(w.sum() / norm, -35, 35)))
        g = (p - y) / norm
        s = (np.sqrt(self.n[x] + g * g) - np.sqrt(self.n[x])) / self.alpha
        self.z[x] += g - s * w
        self.n[x] += g * g

    def compact(self) -> dict[int, float]:
        x = np.flatnonzero(self.n)
        w = self.weights(x)
        return {int(k): float(v) for k, v in zip(x[w != 0], w[w != 0])}


def train(bags: list[list[np.ndarray]], labels: list[int], epochs: int = EPOCHS, bits: int = BITS) -> tuple[dict[int, float], float]:
    """Weights and bias-free threshold from documents (as sentences' features) and their labels.

    First a sentence of an abusive document is suspicious by how few clean documents share its features; then by its score.
    """
    model = Ftrl(bits)
    clean = np.zeros(1 << bits)
    n_clean = 0
    for bag, y in zip(bags, labels):
        if y == 0:
            n_clean += 1
            if bag:
                clean[np.unique(np.concatenate(bag))] += 1
    rng = np.random.default_rng(5)
    order = np.arange(len(bags))
    for epoch in range(epochs):
        rng.shuffle(order)
        for k in order:
            bag = bags[k]
            if not bag:
                continue
            if labels[k]:
                # How suspicious: features that clean documents don't have, then the score.
                rank = [np.mean(clean[x] == 0) for x in bag] if epoch == 0 else model.scores(bag)
                model.learn(bag[int(np.argmax(rank))], 1)
            else:
                for x in bag if epoch == 0 else [x for x, v in zip(bag, model.scores(bag)) if v > -3]:
                    model.learn(x, 0)
    top = np.array([model.scores(bag).max() if bag else -9.0 for bag in bags])
    return model.compact(), choose_threshold(top, np.array(labels))


def choose_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The best F1 on the labelled documents, in the middle of the gap it lies in."""
    order = np.argsort(-scores)
    hit = np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(1, len(order) + 1) + labels.sum()) if len(order) and labels.sum() else np.array([])
    if not len(f1):
        return float("inf")
    k = int(np.argmax(f1))
    low = scores[order[k + 1]] if k + 1 < len(order) else scores[order[k]] - 1
    return float((scores[order[k]] + low) / 2)


#: Words whose features are computed at once.
CHUNK = 100_000


def score_texts(weights: dict[int, float], texts: list[str | None], bits: int = BITS) -> np.ndarray:
    """The score of each text's worst sentence, -9 without any. Sentences of many texts, or parts of a long one, are one array."""
    dense = np.zeros(1 << bits, np.float32)
    dense[list(weights)] = list(weights.values())
    best = np.full(len(texts), -9.0)
    held: list[list[str]] = []
    owner: list[int] = []

    def flush() -> None:
        x, starts = features(held, bits)
        n = np.diff(starts, append=len(x))
        np.maximum.at(best, owner, np.add.reduceat(dense[x], starts, dtype=np.float64) / np.sqrt(n))
        held.clear()
        owner.clear()

    size = 0
    for k, t in enumerate(texts):
        for s in sentences(t):
            held.append(s)
            owner.append(k)
            size += len(s)
            if size >= CHUNK:
                flush()
                size = 0
    if held:
        flush()
    return best


def labelled(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[str, int]]:
    """Texts with the label most reviewers gave; documents on which they disagree evenly are left out."""
    votes = labels.filter("abusive IS NOT NULL").groupBy("doc_id").agg(F.avg("abusive").alias("share")).filter("share <> 0.5")
    # The labels are few beside the documents, but they grow with them: how they are joined is left to the optimiser.
    rows = documents.select("doc_id", "text").filter("text IS NOT NULL").join(votes, "doc_id")
    return [(r.text, int(r.share > 0.5)) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]


def score_documents(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, source, score, abusive) for every document; NULL and empty texts score -9 and are clean.

    Without any abusive label nothing is found abusive. Whole texts are read; equal doc_ids stay separate rows.
    """
    known = labelled(documents, labels, sample)
    weights, threshold = train([bag(t) for t, _ in known], [y for _, y in known])
    sent = documents.sparkSession.sparkContext.broadcast(weights)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = sent.value
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "score": score_texts(w, b["text"].tolist())})

    src = F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source")
    scored = spread(documents.select("doc_id", src, "text")).mapInPandas(read, "doc_id bigint, source string, score double")
    return scored.withColumn("abusive", F.col("score") > threshold)
