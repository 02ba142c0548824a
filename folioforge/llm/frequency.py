"""How often every distinct value or term occurs, and in how many records.

1. The terms of a record are pre-aggregated: one row per (field, term, record) with its
   occurrences, combined map-side, so a hot term or a hot record sends one row per map task.
2. A global integer dictionary numbers the distinct terms: range-partitioned by term, each
   task numbers its own terms and the tasks' offsets, one number a task, are added.
3. Each block of rows is combined into count arrays over identifier ranges of ``WIDTH``; an
   array has the identifiers that occur and their counts, so it is as long as its terms.
4. The arrays are shuffled by range, each range is summed in one dense array at a time, and
   the sums are read back against the dictionary.

A row of (field, term, record) is unique after step 1, so record presence is additive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.session import cut_lineage

#: Identifiers in a count array.
WIDTH = 4096


def dictionary(terms: DataFrame, on: list[str]) -> DataFrame:
    """``on`` plus ``term_id``: dense numbers from 0 in the order of the terms."""
    distinct = terms.select(*on).distinct()
    ordered = distinct.repartitionByRange(*on).sortWithinPartitions(*on)
    numbered = cut_lineage(ordered.withColumn("__at", F.monotonically_increasing_id()))
    block = F.shiftrightunsigned("__at", 33)
    sizes = numbered.groupBy(block.alias("__block")).agg(F.count(F.lit(1)).alias("__n"))
    # One row per task, so the unpartitioned running sum is over a handful of rows.
    starts = sizes.selectExpr(
        "__block", "cast(coalesce(sum(__n) over (order by __block rows between unbounded preceding and 1 preceding), 0) as bigint) as __start"
    )
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    joined = numbered.withColumn("__block", block).join(F.broadcast(starts), "__block")
    return joined.select(*on, (F.col("__start") + within).alias("term_id"))


ARRAYS = "range_id bigint, at array<int>, occurrences array<bigint>, records array<bigint>"
COUNTS = ("occurrences", "records")


def _block_arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Count arrays of each Arrow batch: identifiers within their range, and both counts."""
    for batch in batches:
        if not len(batch):
            continue
        ids, where = np.unique(batch["term_id"].to_numpy(), return_inverse=True)
        sums = {c: np.bincount(where, batch[c].to_numpy(), len(ids)).astype(np.int64) for c in COUNTS}
        ranges, starts = np.unique(ids // WIDTH, return_index=True)
        cut = lambda x: np.split(x, starts[1:])
        yield pd.DataFrame({"range_id": ranges, "at": cut((ids % WIDTH).astype(np.int32)), **{c: cut(sums[c]) for c in COUNTS}})


def _sum_arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sums of arrays that come sorted by range; one dense array is held at a time."""
    now, sums = None, None

    def done() -> pd.DataFrame:
        present = np.flatnonzero(sums[0])
        return pd.DataFrame({"term_id": now * WIDTH + present, "occurrences": sums[0][present], "records": sums[1][present]})

    for batch in batches:
        out = []
        for name, at, occurrences, records in zip(batch["range_id"], batch["at"], batch["occurrences"], batch["records"]):
            if name != now:
                if now is not None:
                    out.append(done())
                now, sums = name, np.zeros((2, WIDTH), np.int64)
            sums[0][at] += occurrences  # an array has each identifier once
            sums[1][at] += records
        if out:
            yield pd.concat(out)
    if now is not None:
        yield done()


def term_frequencies(terms: DataFrame) -> DataFrame:
    """``field_name, term, occurrences, records`` over ``terms(field_name, term, record_id)``.

    Null and blank terms are left out.  A null record counts occurrences and no record.
    Repeated rows are further occurrences of the same record.  An empty table gives no rows.
    """
    on = ["field_name", "term"]
    given = terms.where(F.col("term").isNotNull() & F.col("term").rlike(r"(?U)\S"))
    by_record = given.groupBy(*on, "record_id").agg(F.count(F.lit(1)).alias("occurrences"))
    seen = F.col("record_id").isNotNull().cast("bigint")
    # One row per term and map task of the aggregation above: at most tasks rows a term.
    block = by_record.withColumn("__block", F.spark_partition_id()).groupBy(*on, "__block")
    partial = block.agg(F.sum("occurrences").alias("occurrences"), F.sum(seen).alias("records"))
    partial = cut_lineage(partial)
    numbered = cut_lineage(dictionary(partial, on))
    encoded = partial.join(numbered, on).select("term_id", "occurrences", "records")
    arrays = encoded.mapInPandas(_block_arrays, ARRAYS).repartition("range_id").sortWithinPartitions("range_id")
    summed = arrays.mapInPandas(_sum_arrays, "term_id bigint, occurrences bigint, records bigint")
    return summed.join(numbered, "term_id").select(*on, "occurrences", "records")


def mark_terms(frequencies: DataFrame, n_records: DataFrame, rare_at: int = 1, common_above: float = 0.02) -> DataFrame:
    """Adds ``mark``: ``rare`` at or below ``rare_at`` records, ``common`` above a share, else null.

    ``n_records`` is a one-row table with the number of all records.  A term that is both,
    in a tiny collection, is ``common``.
    """
    (total,) = n_records.columns
    share: Column = F.col("records") > F.col(total) * common_above
    mark = F.when(share, "common").when(F.col("records").between(1, rare_at), "rare")
    return frequencies.crossJoin(F.broadcast(n_records)).withColumn("mark", mark).drop(total)
