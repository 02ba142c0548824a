"""Texts packed whole into containers of a few permitted capacities, measured in tokens.

Variable-capacity best-fit, decreasing, over the histogram of lengths of the whole corpus:

1. The longest length left opens a container.  For each permitted capacity that holds it the
   container is filled best-fit from the lengths left, and the capacity of least cost for
   each token held is opened; it is repeated as often as the lengths allow, so the plan has a
   few thousand patterns, whatever the number of texts.
2. That is done for every choice of permitted capacities that has the largest, and the
   cheapest plan is kept: the capacities are chosen jointly, by what the mix of lengths costs.
3. At the end every container shrinks to the smallest permitted capacity for its contents.
4. The texts of each length are numbered across the corpus and take their places in the plan.

A container of capacity ``c`` costs ``c * (1 + c / ATTENTION)``: a part in proportion to its
tokens, and one to their square.  Only an item longer than the largest capacity is split,
into full containers and a rest that is packed like any other.

Texts are read once and do not move; two numbers a text are shuffled.  Numbers come from
counts of ``BLOCKS`` blocks of ids, so no task holds more than the counts, and the result
does not depend on how the rows are partitioned.

Defined results: null and empty texts have 0 tokens, a row with piece 0 and no container;
repeated rows are items of their own; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import cut_lineage

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how this family of public tokenizers cuts text before merging bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CAPACITIES = (256, 512, 768, 1024)
#: Tokens of a container at which the square part of its cost equals the other.
ATTENTION = 4096
#: Blocks of ids whose lengths are counted apart.
BLOCKS = 256


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    """The tokenizer of a vocabulary file; one for each Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("folioforge", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], vocabulary: str = VOCABULARY) -> list[int]:
    """Tokens of each text, 0 for null."""
    encode = encoding(vocabulary).encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts]


def cost(capacity: int) -> float:
    """Cost of a container."""
    return capacity * (1 + capacity / ATTENTION)


@dataclass
class Pattern:
    """So many containers that each hold the same lengths."""

    lengths: list[int]
    capacity: int
    times: int
    first: int  # number of the first container


def _filled(counts: list[int], longest: int, capacity: int) -> list[int]:
    """The lengths of one container, best-fit from what is left: the longest that still fits, again and again."""
    out, room, at = [longest], capacity - longest, longest
    while room > 0:
        at = min(at, room)
        while at > 0 and counts[at] - out.count(at) <= 0:
            at -= 1
        if at <= 0:
            break
        out.append(at)
        room -= at
    return out


def _plan(histogram: dict[int, int], capacities: tuple[int, ...], permitted: tuple[int, ...]) -> list[Pattern]:
    counts = [0] * (max(capacities) + 1)
    for length, n in histogram.items():
        counts[length] += n
    out: list[Pattern] = []
    number = 0
    for longest in range(max(capacities), 0, -1):
        while counts[longest] > 0:
            options = [(c, _filled(counts, longest, c)) for c in capacities if c >= longest]
            _, lengths = min(options, key=lambda o: (cost(o[0]) / sum(o[1]), o[0]))
            held = {n: lengths.count(n) for n in lengths}
            times = min(counts[n] // k for n, k in held.items())
            for n, k in held.items():
                counts[n] -= k * times
            size = sum(lengths)
            out.append(Pattern(lengths, next(c for c in permitted if c >= size), times, number))
            number += times
    return out


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES) -> list[Pattern]:
    """The patterns of the cheapest choice of capacities for a histogram of lengths.

    Lengths lie between 1 and the largest capacity.
    """
    permitted = tuple(sorted(capacities))
    *others, largest = permitted
    choices = [(*c, largest) for k in range(len(others), -1, -1) for c in combinations(others, k)]
    plans = [_plan(histogram, c, permitted) for c in choices]
    return min(plans, key=lambda p: sum(cost(x.capacity) * x.times for x in p))


class Places:
    """Where the text of a length and number goes."""

    def __init__(self, patterns: list[Pattern]):
        self.starts: dict[int, list[int]] = defaultdict(list)
        self.ranges: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # texts a container, first container, capacity
        taken: dict[int, int] = defaultdict(int)
        for p in patterns:
            for length in dict.fromkeys(p.lengths):
                k = p.lengths.count(length)
                self.starts[length].append(taken[length])
                self.ranges[length].append((k, p.first, p.capacity))
                taken[length] += k * p.times

    def of(self, length: int, number: int) -> tuple[int, int]:
        """Container and capacity of the text with that number among those of its length."""
        at = bisect_right(self.starts[length], number) - 1
        k, first, capacity = self.ranges[length][at]
        return first + (number - self.starts[length][at]) // k, capacity


ITEMS = "doc_id bigint, piece int, token_from int, token_to int, n_tokens int"
ROWS = f"{ITEMS}, container_id bigint, capacity int"


def pack_documents(documents: DataFrame, vocabulary: str = VOCABULARY, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """One row for each text, or piece of a text longer than the largest capacity, with its container."""
    largest = max(capacities)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, n in zip(batch["doc_id"], count_tokens(batch["text"].tolist(), vocabulary)):
                rows.extend((doc, p, at, min(n, at + largest), min(n, at + largest) - at) for p, at in enumerate(range(0, max(n, 1), largest)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "token_from", "token_to", "n_tokens"])

    items = cut_lineage(documents.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(measure, ITEMS))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(BLOCKS)).cast("int")
    held = items.where("n_tokens > 0").withColumn("block", block)
    # at most BLOCKS times the largest capacity rows
    counts = held.groupBy("block", "n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()
    table = np.zeros((BLOCKS, largest + 1), dtype=np.int64)
    for r in counts:
        table[r.block, r.n_tokens] = r.n
    totals = table.sum(axis=0)
    patterns = plan({int(n): int(totals[n]) for n in np.flatnonzero(totals)}, capacities)
    shared = documents.sparkSession.sparkContext.broadcast((np.cumsum(table, axis=0) - table, Places(patterns)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, places = shared.value
        # a block is whole in one task and sorted, so that equal runs number alike
        seen: dict[tuple[int, int], int] = defaultdict(int)
        for batch in batches:
            out = []
            for b, n in zip(batch["block"], batch["n_tokens"]):
                out.append(places.of(n, int(before[b, n]) + seen[b, n]))
                seen[b, n] += 1
            yield batch.drop(columns="block").assign(container_id=[c for c, _ in out], capacity=[c for _, c in out])

    placed = held.repartition("block").sortWithinPartitions("block", "n_tokens", "doc_id", "piece").mapInPandas(place, ROWS)
    nothing = items.where("n_tokens = 0").selectExpr("*", "cast(null as bigint) as container_id", "cast(null as int) as capacity")
    return placed.unionByName(nothing)


def fill(packed: DataFrame) -> DataFrame:
    """``capacity, containers, tokens, unused``: how full the containers of each capacity are."""
    one = packed.where("container_id is not null").groupBy("container_id", "capacity").agg(F.sum("n_tokens").alias("tokens"))
    by = one.groupBy("capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    return by.withColumn("unused", 1 - F.col("tokens") / (F.col("capacity") * F.col("containers")))
