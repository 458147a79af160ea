"""Problem 9: sources mixed to target weights by a multivariate-hypergeometric splitting tree.

Sizes are tokens of a public tokenizer. Every source is cut into blocks by a hash of the document id (at most
``BLOCKS`` per source, so block totals on the driver are bounded by the number of sources). A source's quota becomes a
number of block draws: all blocks as often as the quota holds the source, then a prefix of a random permutation, never
more than ``max_repeats`` rounds. The draws of all sources are shared out among the output shards by a tree: a node
gives its left half a multivariate-hypergeometric sample of its draws, so every shard is a fair sample of the mixture
and the quotas stay exact. A source's permuted draws are then dealt to the shards in order, so no draw comes twice, and
each shard is ordered by a hash of its own.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vahini.session import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCKS = 2048
# Fixed value: how the byte-level vocabulary splits text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters given to the tokenizer at once; longer texts are cut between the pieces that PATTERN makes, which no token crosses.
PART = 200_000


@lru_cache(4)
def _counter(path: str) -> Callable[[str], int]:
    import regex
    import tiktoken

    pieces = regex.compile(PATTERN)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    coding = tiktoken.Encoding("vahini", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(text: str) -> int:
        n, begin = 0, 0
        while len(text) - begin > PART:
            # The piece that stands at the limit begins where the last one before it ends: found from the last blank on, if there is one.
            blank = text.rfind(" ", begin + 1, begin + PART)
            at = next(m.end() for m in pieces.finditer(text, blank if blank > 0 else begin) if m.end() >= begin + PART)
            n += len(coding.encode_ordinary(text[begin:at]))
            begin = at
        return n + len(coding.encode_ordinary(text[begin:]))

    return count


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens): source in lower case without outer spaces, '' for NULL; a NULL text has 0 tokens."""

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _counter(tokenizer)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": [count(t) if t else 0 for t in b["text"]]})

    src = F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source")
    return spread(documents.select("doc_id", src, "text")).mapInPandas(sized, "doc_id bigint, source string, n_tokens bigint")


def plan_targets(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Per plan and source: weight share, tokens there, tokens wanted (of all documents counted once), tokens at the cap.

    Repeated rows of a plan count once; a source without documents has 0 tokens; NULL or negative weights count 0 and a
    NULL max_repeats 1. A plan whose weights sum to 0 wants nothing.
    """
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))
    plans = plan.select("plan_id", "source", "weight", "max_repeats").dropDuplicates(["plan_id", "source"])
    plans = plans.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).withColumn("key", F.coalesce(F.lower(F.trim("source")), F.lit("")))
    sums = plans.groupBy("plan_id").agg(F.sum("weight").alias("weights"))
    total = have.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total"))
    return (
        plans.join(sums, "plan_id")
        .join(have.withColumnRenamed("source", "key"), "key", "left")
        .crossJoin(F.broadcast(total))  # one row
        .select(
            "plan_id", "source", "key", F.coalesce(F.try_divide("weight", "weights"), F.lit(0.0)).alias("target_share"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
            F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), "total",
        )
        .withColumn("wanted", F.col("target_share") * F.col("total"))
        .withColumn("at_cap", F.col("n_tokens") * F.col("max_repeats"))
    )


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Draws per (shard, source): a node hands a multivariate-hypergeometric sample to its left half."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    n = int(quotas.sum() * left // shards)
    mine = rng.multivariate_hypergeometric(quotas, n, method="marginals") if quotas.sum() else quotas
    return np.vstack([split_tree(mine, left, rng), split_tree(quotas - mine, shards - left, rng)])


def mixture(documents: DataFrame, plan: DataFrame, shards: int = 16, seed: int = 17, tokenizer: str = TOKENIZER, blocks: int = BLOCKS) -> DataFrame:
    """(plan_id, source, shard, position_key, doc_id, repeat_no, n_tokens): the mixture, a row per copy of a document.

    Order a shard by position_key for its local shuffle. Documents of sources outside the plan are not in the mixture;
    documents without tokens are, as often as their block.
    """
    return mixture_of(cut(token_sizes(documents, tokenizer)), plan, shards, seed, blocks)


def mixture_of(sizes: DataFrame, plan: DataFrame, shards: int = 16, seed: int = 17, blocks: int = BLOCKS) -> DataFrame:
    """``mixture`` from sizes that are there already."""
    spark = sizes.sparkSession
    blocked = sizes.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(blocks)).cast("int"))
    targets = plan_targets(sizes, plan).filter("n_docs > 0 AND target_share > 0").collect()
    # Only the plan's sources, so that what comes to the driver is bounded by the plan.
    blocked = blocked.filter(F.col("source").isin(sorted({t.key for t in targets}))) if targets else blocked.limit(0)
    held: dict[str, list[tuple[int, int]]] = {}
    for r in blocked.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")).collect():
        held.setdefault(r.source, []).append((r.block, r.n))
    deals = []
    for pid in sorted({t.plan_id for t in targets}):
        rng = np.random.default_rng([seed, pid])
        mine = sorted((t for t in targets if t.plan_id == pid), key=lambda t: t.key)
        draws = []
        for t in mine:
            ids = sorted(held[t.key])
            order = rng.permutation(len(ids))
            quota = min(t.wanted, float(t.at_cap))
            rounds = min(t.max_repeats, int(quota // t.n_tokens) if t.n_tokens else 0)
            dealt = [(ids[k][0], r) for r in range(rounds) for k in rng.permutation(len(ids))]
            rest = quota - rounds * t.n_tokens
            if rounds < t.max_repeats:
                for k in order:
                    if rest < ids[k][1] / 2:
                        break
                    rest -= ids[k][1]
                    dealt.append((ids[k][0], rounds))
            draws.append(dealt)
        counts = split_tree(np.array([len(d) for d in draws], dtype=np.int64), shards, rng)
        for t, dealt, per_shard in zip(mine, draws, counts.T):
            for (block, repeat), shard in zip(dealt, np.repeat(np.arange(shards), per_shard)):
                deals.append((pid, t.source, t.key, int(block), int(repeat), int(shard)))
    schema = "plan_id int, plan_source string, source string, block int, repeat_no int, shard int"
    dealt_df = spark.createDataFrame(pd.DataFrame(deals, columns=[c.split()[0] for c in schema.split(", ")]), schema) if deals else spark.createDataFrame([], schema)
    # The deals are bounded by sources x blocks x repeats, whatever the documents; the optimiser sees their size.
    return blocked.join(dealt_df, ["source", "block"]).select(
        "plan_id", F.col("plan_source").alias("source"), "shard",
        F.xxhash64(F.lit(seed), "plan_id", "shard", "doc_id", "repeat_no").alias("position_key"), "doc_id", "repeat_no", "n_tokens",
    )


def actual_shares(documents: DataFrame, plan: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per plan and source: tokens in the mixture, share wanted and reached, and whether the cap leaves it short.

    (plan_id, source, target_share, wanted, mixed_tokens, actual_share, n_rows, short). A source that is short is in
    the mixture with all its documents, max_repeats times.
    """
    sizes = cut(token_sizes(documents, tokenizer))
    targets = plan_targets(sizes, plan)
    mixed = mixture_of(sizes, plan).groupBy("plan_id", "source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count("*").alias("n_rows"))
    sums = mixed.groupBy("plan_id").agg(F.sum("mixed_tokens").alias("plan_tokens"))
    mixed_tokens = F.coalesce("mixed_tokens", F.lit(0))
    return (
        targets.join(mixed, ["plan_id", "source"], "left")
        .join(sums, "plan_id", "left")
        .select(
            "plan_id", "source", "target_share", "wanted", mixed_tokens.alias("mixed_tokens"),
            F.coalesce(F.try_divide("mixed_tokens", "plan_tokens"), F.lit(0.0)).alias("actual_share"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
            ((F.col("at_cap") < F.col("wanted")) & (mixed_tokens == F.col("at_cap"))).alias("short"),
        )
    )
