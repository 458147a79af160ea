"""Names of winners resolved against known firms: exact, merged, to be reviewed, new."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vahini.operators.pairing import CELLS, in_slices

MERGE, REVIEW = 95.0, 85.0


def ratio(a: list[str], b: list[str]) -> float:
    """0 to 100 for two sorted word sets: the best of what they share against each whole, and of the two wholes."""
    x, y = set(a), set(b)
    shared = " ".join(sorted(x & y))
    wholes = [" ".join([shared, *sorted(x - y)]).strip(), " ".join([shared, *sorted(y - x)]).strip()]
    pairs = ((shared, wholes[0]), (shared, wholes[1]), (wholes[0], wholes[1]))
    return 100.0 * max(SequenceMatcher(None, p, q).ratio() for p, q in pairs)


def common_letters(masks: dict[str, int], length: int, b: str) -> int:
    """Length of the longest common subsequence of b and the text of that length of which ``masks`` has each letter's places as bits."""
    left = full = (1 << length) - 1
    for c in b:
        m = left & masks.get(c, 0)
        left = ((left + m) | (left - m)) & full
    return length - left.bit_count()


class Firms:
    """Names that hold one word, for the best of them by ``ratio``: it is worked out only where bounds leave it open.

    The shared words against a whole give at most 2s / (s + length), the wholes at most their common letters (first as
    numbers of letters, then in order). ``ratio`` itself is asked in the order of the bounds, until none can be better.
    """

    def __init__(self, ids: list, words: list[list[str]]):
        order = sorted(range(len(ids)), key=ids.__getitem__)
        self.ids, self.words = [ids[i] for i in order], [words[i] for i in order]
        self.text = [" ".join(w) for w in self.words]
        self.length = np.array([len(x) for x in self.text])
        self.letter = {c: k for k, c in enumerate(sorted(set("".join(self.text))))}
        self.counts = np.zeros((len(self.letter), len(ids)), np.int16)
        self.having: dict[str, list[int]] = {}
        for i, (x, ws) in enumerate(zip(self.text, self.words)):
            for c in x:
                self.counts[self.letter[c], i] += 1
            for w in ws:
                self.having.setdefault(w, []).append(i)
        self.at = {w: np.array(x) for w, x in self.having.items()}

    def best(self, words: list[str]) -> tuple[float, object]:
        """(score, id): the highest score, of equal ones the smallest id."""
        text = " ".join(words)
        shared = np.zeros(len(self.ids), np.int64)
        for w in words:
            if w in self.at:
                shared[self.at[w]] += len(w) + 1
        shared = np.maximum(shared - 1, 0)
        both = np.zeros(len(self.ids), np.int64)
        for c in set(text) & set(self.letter):
            both += np.minimum(self.counts[self.letter[c]], text.count(c))
        part = 200.0 * shared / np.maximum(1, shared + np.minimum(len(text), self.length))
        whole = 200.0 * both / np.maximum(1, len(text) + self.length)
        bound = np.maximum(part, whole)
        # Long texts have letters that SequenceMatcher leaves out, so only short ones reach the shared words' part for certain.
        sure = np.max(np.where(self.length + len(text) < 200, part, 0.0), initial=0.0) - 1e-9
        left = np.flatnonzero(bound >= sure)
        left = left[np.argsort(-bound[left], kind="stable")]
        score, at = -1.0, -1
        seen: dict[frozenset, tuple[dict[str, int], str]] = {}
        for i in left.tolist():
            if bound[i] + 1e-9 < score:
                break
            mine = frozenset(words) & frozenset(self.words[i])
            if mine not in seen:
                a = " ".join([*sorted(mine), *(w for w in words if w not in mine)])
                masks: dict[str, int] = {}
                for k, c in enumerate(a):
                    masks[c] = masks.get(c, 0) | 1 << k
                seen[mine] = masks, " ".join(sorted(mine))
            masks, begin = seen[mine]
            if part[i] + 1e-9 < max(score, sure):
                b = " ".join([*([begin] if begin else []), *(w for w in self.words[i] if w not in mine)])
                if 200.0 * common_letters(masks, len(text), b) / max(1, len(text) + len(b)) + 1e-9 < max(score, sure):
                    continue
            now = ratio(words, self.words[i])
            if now > score or now == score and i < at:
                score, at = now, i
        return score, self.ids[at]


def _best(firms: pa.Table, keys: pa.Table) -> pa.Table:
    got = []
    if len(firms) and len(keys):
        known = Firms(firms["firm_id"].to_pylist(), firms["fw"].to_pylist())
        got = [known.best(w) for w in keys["nw"].to_pylist()]
    return pa.table({"key": keys["key"].slice(0, len(got)).cast(pa.string()), "firm_id": pa.array([i for _, i in got], firms["firm_id"].type), "score": pa.array([s for s, _ in got], pa.float64())})


def resolve(names: DataFrame, firms: DataFrame) -> DataFrame:
    """(key, firm_id, score, decision) for every key of ``names(key)`` against ``firms(firm_id, key)``.

    "exact" for an equal key, "merged" from MERGE on, "review" from REVIEW on (a new firm and an entry to be looked at),
    else "new" (no firm or none alike; firm_id is that of the best candidate, if there is one). Candidates share the first
    word of the name; of equal scores the smallest firm_id is best. NULL and blank keys are left out, equal keys come once.
    """
    keys = names.filter("trim(key) <> ''").select("key").distinct()
    known = firms.filter("trim(key) <> ''").groupBy("key").agg(F.min("firm_id").alias("firm_id"))
    met = keys.join(known, "key", "left")
    exact = met.filter("firm_id IS NOT NULL").select("key", "firm_id", F.lit(100.0).alias("score"))
    rest = met.filter("firm_id IS NULL").select("key")
    words = lambda c: F.array_sort(F.array_distinct(F.split(c, " ")))
    by_word = known.select("firm_id", words(F.col("key")).alias("fw")).withColumn("word", F.explode("fw"))
    asked = rest.select("key", words(F.col("key")).alias("nw"), F.split("key", " ")[0].alias("word"))
    best = in_slices(by_word, asked, "word", "key", _best, f"key string, firm_id {known.schema['firm_id'].dataType.simpleString()}, score double", CELLS // 4)
    scored = exact.unionByName(rest.join(best, "key", "left"))
    decision = F.when(F.col("score") == 100.0, F.lit("exact")).when(F.col("score") >= MERGE, "merged").when(F.col("score") >= REVIEW, "review").otherwise("new")
    return scored.select("key", "firm_id", F.round("score", 1).alias("score"), decision.alias("decision"))
