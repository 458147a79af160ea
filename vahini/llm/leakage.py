"""Problem 8: held-out evaluation items inside corpus documents, as a prefix-filtered set join.

Shingles here are pairs of neighbouring words, because a case needs only 55 of 100 words in order, with words changed
and the passage interrupted (the statement overrides the usual five words at 0.8). In a document a pair may have one
word more between its two, so single words added tear none. If at least a share ``share`` of an item's n words is
matched, at least ``2 * share * n - n - 1`` neighbouring pairs have both words matched; of those ``SPLIT`` may be torn
apart by longer interruptions. An item's shingles are ordered by their number of documents in the whole corpus, rarest
first; a document that holds ``least`` of m shingles holds one of the first m - least + 1. Candidates are then bounded
by length and by the number of distinct shared shingles, and verified exactly: the longest common subsequence with the
item (bit-parallel) over windows of ``WINDOW`` item lengths, and, in longer documents, over the fragments of the item
(``FRAGMENT`` shingles close together), however far apart, so that a passage may be interrupted at any length.

The items go out behind a check of their number, in blocks of ``BLOCK``; each block is one map over the documents and
nothing of the corpus is shuffled but the shingle counts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vahini.llm.words import words
from vahini.session import spread

SHARE = 0.55
SPLIT = 2
WINDOW = 8
BLOCK = 20_000


def bits(item: list[str]) -> dict[str, int]:
    """Positions of each word of an item as a bit mask."""
    out: dict[str, int] = {}
    for i, w in enumerate(item):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common(masks: dict[str, int], n: int, text: list[str]) -> int:
    """Length of the longest common subsequence of an item of n words and a text."""
    full = (1 << n) - 1
    v = full
    for w in text:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def best_window(masks: dict[str, int], n: int, text: list[str], window: int = WINDOW) -> int:
    """The most common words in order within any window of the text; windows overlap by half."""
    size = window * n
    if len(text) <= size:
        return common(masks, n, text)
    return max(common(masks, n, text[a : a + size]) for a in range(0, len(text) - size // 2, size // 2))


#: Matched shingles at most so many words apart are of one fragment; so many words on each side of them belong to it too.
REACH = 4
#: Distinct shingles that make a fragment; fewer are chance in a long text.
FRAGMENT = 4


def around(shingles: set, text: list[str]) -> list[str]:
    """The words of the fragments of an item in a text."""
    groups: list[list[int]] = []
    for i, pair in enumerate(zip(text, text[1:])):
        if pair in shingles:
            if not groups or i - groups[-1][-1] > REACH:
                groups.append([])
            groups[-1].append(i)
    near = [i for g in groups if len({(text[i], text[i + 1]) for i in g}) >= FRAGMENT for i in g]
    keep = sorted({j for i in near for j in range(max(0, i - REACH), min(len(text), i + 2 + REACH))})
    return [text[j] for j in keep]


def most_in_order(shingles: set, masks: dict[str, int], n: int, text: list[str]) -> int:
    """The item's words found in order: in a window, or in the fragments of a long text."""
    got = best_window(masks, n, text)
    return got if len(text) <= WINDOW * n else max(got, common(masks, n, around(shingles, text)))


def least_shingles(n: int, share: float, distinct: int) -> int:
    """Fewest distinct shingles of a document that holds the share of an item of n words with so many distinct ones."""
    return max(1, int(2 * share * n - n - 1e-9) - 1 - SPLIT - (n - 1 - distinct))


class Items:
    """A block of items: words, masks and, once the counts are known, the prefix index."""

    def __init__(self, rows: list[tuple[int, str]], share: float):
        self.share = share
        self.words = {i: w for i, t in sorted(rows) if (w := words(t))}
        self.masks = {i: bits(w) for i, w in self.words.items()}
        self.shingles = {i: set(zip(w, w[1:])) or {(w[0], "")} for i, w in self.words.items()}
        self.ids = {s: k for k, s in enumerate(sorted(set().union(*self.shingles.values())))} if self.words else {}
        self.prefix: dict[int, list[int]] = {}
        self.all: dict[int, list[int]] = defaultdict(list)
        self.single = any(len(w) == 1 for w in self.words.values())

    def order(self, counts: dict[int, int]) -> None:
        prefix = defaultdict(list)
        self.least = {i: least_shingles(len(w), self.share, len(self.shingles[i])) for i, w in self.words.items()}
        for i, ss in self.shingles.items():
            ranked = sorted((self.ids[s] for s in ss), key=lambda k: (counts.get(k, 0), k))
            for k in ranked[: max(1, len(ranked) - self.least[i] + 1)]:
                prefix[k].append(i)
            for k in ranked:
                self.all[k].append(i)
        self.prefix = dict(prefix)

    def of(self, text: list[str]) -> set[int]:
        """Ids of the shingles of a document that occur in items."""
        pairs = {*zip(text, text[1:]), *zip(text, text[2:])}
        if self.single:
            pairs |= {(w, "") for w in text}
        return {self.ids[s] for s in self.ids.keys() & pairs}

    def found(self, text: list[str]) -> list[tuple[int, float]]:
        """(item, share of its words found in order), for shares of at least ``share``."""
        mine = self.of(text)
        if not mine:
            return []
        candidates = {i for k in mine for i in self.prefix.get(k, ())}
        if not candidates:
            return []
        shared = Counter(i for k in mine for i in self.all[k] if i in candidates)
        have = set(text)
        out = []
        for i, k in shared.items():
            n = len(self.words[i])
            if k < self.least[i] or len(text) < self.share * n:
                continue
            if sum(m.bit_count() for w, m in self.masks[i].items() if w in have) < self.share * n:
                continue
            got = most_in_order(self.shingles[i], self.masks[i], n, text)
            if got >= self.share * n - 1e-9:
                out.append((i, got / n))
        return out


def find_leaks(documents: DataFrame, items: DataFrame, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, share_found) for every document that holds at least ``share`` of an item's words in order.

    NULL, empty and symbol-only texts hold nothing; an item without words is in no document. Whole texts are read,
    whatever their length. Equal doc_ids are one document (each of its texts is searched).
    """
    spark = documents.sparkSession
    docs = spread(documents.select("doc_id", "text").filter("text IS NOT NULL"))
    ids = items.select("item_id").filter("item_id IS NOT NULL")
    blocks = max(1, -(-ids.count() // block))
    parts = []
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").collect()
        sent = spark.sparkContext.broadcast([tuple(r) for r in rows])

        def counted(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            block_items, total = Items(sent.value, share), Counter()
            for batch in batches:
                for t in batch["text"]:
                    total.update(block_items.of(words(t)))
            yield pd.DataFrame({"shingle": list(total), "n": list(total.values())}, dtype="int64")

        counts = docs.mapInPandas(counted, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
        ranks = spark.sparkContext.broadcast({r.shingle: r.n for r in counts.collect()})

        def searched(batches: Iterator[pd.DataFrame], sent=sent, ranks=ranks) -> Iterator[pd.DataFrame]:
            block_items = Items(sent.value, share)
            block_items.order(ranks.value)
            for batch in batches:
                hits = [(d, i, s) for d, t in zip(batch["doc_id"], batch["text"]) for i, s in block_items.found(words(t))]
                yield pd.DataFrame(hits, columns=["doc_id", "item_id", "share_found"])

        parts.append(docs.mapInPandas(searched, "doc_id bigint, item_id bigint, share_found double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "item_id").agg(F.max("share_found").alias("share_found"))
