"""Pairs of two tables under one key, found group by group in numpy: few of very many pairs that share a key count.

A group is a key and a slice of the rows of one side, so that none has more than ``CELLS`` pairs to look at, however many
rows a key has. The other side goes to every slice of its key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vahini.session import shuffle_partitions

CELLS = 8_000_000
#: Needles meet a text on so many letters of their beginning.
HEAD = 6


def sliced(few: DataFrame, many: DataFrame, key: str, by: str, cells: int, counted: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``slice`` for their equal keys; ``many`` is sliced by a hash of the column ``by``. NULL keys meet nothing.

    ``counted``: the keys of both sides as they are cheap to read, repeats included, as they only tell how many slices to make.
    """
    few, many = few.filter(F.col(key).isNotNull()), many.filter(F.col(key).isNotNull())
    fewer, more = (x.filter(F.col(key).isNotNull()).groupBy(key) for x in counted or (few, many))
    n = more.agg(F.count("*").alias("n_many")).join(fewer.agg(F.count("*").alias("n_few")), key)
    n = n.select(key, (F.floor(F.col("n_many") * F.col("n_few") / cells) + 1).cast("int").alias("slices"))
    a = few.join(n, key).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    b = many.join(n, key).withColumn("slice", F.pmod(F.xxhash64(by), F.col("slices")).cast("int")).drop("slices")
    return a, b


def in_slices(few: DataFrame, many: DataFrame, key: str, by: str, read: Callable[[pa.Table, pa.Table], pa.Table], schema: str, cells: int = CELLS, *, counted: tuple[DataFrame, DataFrame] | None = None, prepare: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """What ``read`` makes of the rows of both sides with one key. ``prepare`` is done to rows of ``many`` that meet any, key and slice kept."""
    a, b = sliced(few, many, key, by, cells, counted)
    a, b = (x.repartition(_tasks(few), key, "slice") for x in (a, prepare(b)))
    return a.groupBy(key, "slice").cogroup(b.groupBy(key, "slice")).applyInArrow(read, schema)


def all_pairs(few: DataFrame, many: DataFrame, key: str, by: str, cells: int = CELLS // 8) -> DataFrame:
    """The join by a key whose pairs are by far more than its rows."""
    a, b = (x.repartition(_tasks(few), key, "slice") for x in sliced(few, many, key, by, cells))
    return a.join(b, [key, "slice"]).drop("slice")


def _tasks(df: DataFrame) -> int:
    """Tasks for the pairs: AQE would have them as few as the rows' bytes ask for."""
    return 4 * max(shuffle_partitions(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism)


def holders(needles: list[str | None], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for every needle i that stands in text j. NULL stands in nothing and holds nothing, '' stands in all texts."""
    at: dict[str, list[int]] = {}
    for i, x in enumerate(needles):
        if x is not None:
            at.setdefault(x, []).append(i)
    heads: dict[int, dict[str, list[str]]] = {}
    for x in at:
        heads.setdefault(min(len(x), HEAD), {}).setdefault(x[:HEAD], []).append(x)
    left: list[int] = []
    right: list[int] = []
    for j, text in enumerate(texts):
        if text is None:
            continue
        found: set[str] = set()
        for k, table in heads.items():
            if len(table) <= 16:
                for head, begun in table.items():
                    i = text.find(head)
                    while i >= 0:
                        found.update(x for x in begun if text.startswith(x, i))
                        i = text.find(head, i + 1)
            else:
                for i in range(len(text) - k + 1):
                    if (begun := table.get(text[i : i + k])) is not None:
                        found.update(x for x in begun if text.startswith(x, i))
        for x in found:
            left += at[x]
            right += [j] * len(at[x])
    return np.array(left, np.int64), np.array(right, np.int64)


def either_holds(a: list[str | None], b: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) where a[i] stands in b[j] or b[j] in a[i]; NULL and blank ones never. A pair may come twice."""
    a, b = [x or None for x in a], [x or None for x in b]
    longest = max((len(x) for x in a if x), default=0)
    i, j = holders(a, b)
    l, k = holders([x if x and len(x) < longest else None for x in b], a)
    return np.concatenate([i, k]), np.concatenate([j, l])


def codes(c: pa.ChunkedArray) -> tuple[list, np.ndarray]:
    """Distinct values and each row's number among them."""
    d = pc.dictionary_encode(c, null_encoding="encode").combine_chunks()
    d = d.chunk(0) if isinstance(d, pa.ChunkedArray) else d
    return d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False).astype(np.int64)


class Words:
    """Sets of words of two sides: which share so many. Words are numbered by the first side's, others left out.

    ``of`` and ``many_of`` have the number of each row's set on its side.
    """

    def __init__(self, few: pa.ChunkedArray, many: pa.ChunkedArray):
        sets, self.of = codes(pc.binary_join(pc.cast(few, pa.list_(pa.string())), "\u0001"))
        self.number: dict[str, int] = {}
        listed = [[self.number.setdefault(w, len(self.number)) for w in s.split("\u0001")] if s else [] for s in sets]
        self.n_sets = len(listed)
        self.row, self.word = np.repeat(np.arange(len(listed)), [len(x) for x in listed]), np.array([w for x in listed for w in x], np.int64)
        many = many.combine_chunks()
        many = many.chunk(0) if isinstance(many, pa.ChunkedArray) else many
        length = pc.fill_null(pc.list_value_length(many), 0).to_numpy(zero_copy_only=False)
        values, at = codes(pa.chunked_array([many.flatten()]))
        known = np.array([self.number.get(v, -1) for v in values], np.int64)[at] if values else np.zeros(0, np.int64)
        rows, keep = np.repeat(np.arange(len(many)), length), known >= 0
        rows, known = rows[keep], known[keep]
        known = known[np.lexsort((known, rows))]
        ends = np.cumsum(np.bincount(rows, minlength=len(many)))
        found: dict[bytes, int] = {}
        self.many_of = np.array([found.setdefault(known[i:j].tobytes(), len(found)) for i, j in zip([0, *ends[:-1]], ends)], np.int64)
        self.n_many = len(found)
        listed = [np.frombuffer(x, np.int64) for x in found]
        self.many_row, self.many_word = np.repeat(np.arange(len(listed)), [len(x) for x in listed]), np.concatenate([known[:0], *listed])

    def share(self, least: int) -> np.ndarray:
        """Sets of the first side by sets of the second."""
        total = np.zeros((self.n_sets, self.n_many), np.float32)
        wide = max(1, min(len(self.number), max(64, CELLS // max(1, self.n_sets, self.n_many))))
        for w in range(0, len(self.number), wide):
            a, b = np.zeros((self.n_sets, wide), np.float32), np.zeros((wide, self.n_many), np.float32)
            here, there = (self.word >= w) & (self.word < w + wide), (self.many_word >= w) & (self.many_word < w + wide)
            a[self.row[here], self.word[here] - w], b[self.many_word[there] - w, self.many_row[there]] = 1, 1
            total += a @ b
        return total >= least


class Classes:
    """Rows that are alike in all the codes given, as one class: ``of`` has each row's, ``codes`` a class's codes."""

    def __init__(self, *codes: np.ndarray):
        kinds, self.of = np.unique(np.stack(codes), axis=1, return_inverse=True)
        self.codes, self.of = list(kinds), self.of.ravel()
        self.rows = np.argsort(self.of, kind="stable")
        self.size = np.bincount(self.of, minlength=len(kinds[0]))
        self.begin = np.cumsum(self.size) - self.size

    def members(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of these classes one after the other, and how many each has."""
        n = self.size[classes]
        return self.rows[np.repeat(self.begin[classes] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which are among those known, which are sorted."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def blocks(n_few: int, n_many: int, cells: int = CELLS // 2) -> Iterator[tuple[int, int]]:
    step = max(1, cells // max(1, n_few))
    return ((k, min(n_many, k + step)) for k in range(0, n_many, step))
