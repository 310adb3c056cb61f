"""Shards of nearly equal size, by sampled splitters.

Rows are put in the order of a key: a hash of the text, then the document's key. A first pass reduces every row to key,
size and checksum. Keys are then sampled in proportion to their rows' sizes, quantiles of the sample become splitters,
and the rows are dealt out to the ranges between them. Sizes and counts of the ranges are counted; a range that came out
overfull is subdivided by a sample of its own until none is left. What the splitters decide is which rows meet in a task,
and not the result: with the sizes of the ranges before it known, a row's place among all bytes is exact, and its shard
is the part of all bytes that its middle falls in.

Equal texts are neighbours in that order. A group of equal texts goes to one shard, by the middle of the group, unless it
has more than a KEEPth of a shard's bytes; a larger group is cut where the shards end, as no shards of equal size can hold
it whole.

No text is moved or kept: only the narrow rows are. The driver holds splitters and the sums of ranges, whose number is
set by PER_SHARD and RANGE_ROWS, and samples of OVERSAMPLE keys a range. Splitters are a sorted array that each task searches.

Nulls: a null text has 0 bytes and is equal to an empty one; a null key is before all others. Repeated rows are rows of
their own. They have one key but for the number of their part of the input, which tells them apart, so that a row that is
repeated very often is subdivided too; which of them gets which place can't be seen. An empty table has no rows. A
text's length doesn't matter after the first pass; a single row larger than a shard leaves that shard larger, and as many
of the shards after it empty as its bytes cover.
"""

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from scorewright.llm.session import checkpointed, partitions

SHARDS = 24
# Ranges for each shard at least, and rows that a range is to have at most, where the table has more rows than that.
PER_SHARD, RANGE_ROWS = 16, 1_000_000
# Sampled keys for each range, and how often its share a range may hold before it is subdivided.
OVERSAMPLE, OVERFULL = 20, 3
# Groups of equal texts of at most one part in so many of a shard stay together.
KEEP = 100

_KEY = ("_h", "_k", "_p")


def _narrow(docs: DataFrame, key: str, text: str, *carried: Column) -> DataFrame:
    """Key, size and checksum of each row: 40 bytes, whatever the text; and what else it is to carry."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        (F.octet_length(whole) + F.lit(8)).cast("long").alias("size"),
        F.crc32(whole).alias("text_crc32"),
        F.conv(F.left(F.md5(whole), F.lit(15)), 16, 10).cast("long").alias("_h"),
        F.spark_partition_id().alias("_p"),
        *carried,
    ).withColumn("_k", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))


def _unit(*columns: str) -> Column:
    """A number from 0 to 1 that a row keeps when its task runs again."""
    return F.pmod(F.xxhash64(*columns, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _drawn(rows: DataFrame, each: Column) -> list[tuple]:
    """Keys in proportion to size: one for each ``each`` bytes on average, as (hash, key, part, times)."""
    times = F.floor(F.col("size") / each + _unit("_h", "_k", "_p", "size")).cast("long")
    # Repeated rows of one input part have one key and one sample.
    found = rows.groupBy(*_KEY, "size").agg(F.sum(times).alias("times")).where("times > 0")
    return [tuple(row) for row in found.select(*_KEY, "times").collect()]


def _quantiles(sample: list[tuple], parts: int) -> list[tuple]:
    """Keys that cut the sample into parts of equal weight; a text's rows stay together unless they weigh more than a part."""
    sample = sorted(sample)
    total = sum(s[-1] for s in sample)
    heavy: dict[int, int] = {}
    for s in sample:
        heavy[s[0]] = heavy.get(s[0], 0) + s[-1]
    found, before, wanted = set(), 0, 1
    for s in sample:
        before += s[-1]
        if before * parts >= wanted * total:
            whole = heavy[s[0]] * parts <= total
            found.add((s[0], -(1 << 63), -1) if whole else s[:3])
            wanted = before * parts // total + 1
    return sorted(found)


def _search(splitters: list[tuple]):
    """A function from batches of rows to the same with ``_r``, the number of splitters that are not above the row's key."""
    heads = np.array([s[0] for s in splitters], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("_h").to_numpy(zero_copy_only=False)
            low, found = np.searchsorted(heads, h, "left"), np.searchsorted(heads, h, "right")
            tied = np.flatnonzero(low < found)
            if len(tied):
                k, p = (batch.column(name).to_numpy(zero_copy_only=False)[tied] for name in ("_k", "_p"))
                found[tied] = [bisect_right(splitters, key) for key in zip(h[tied].tolist(), k.tolist(), p.tolist())]
            yield batch.append_column("_r", pa.array(found.astype(np.int32)))

    return run


def _ranged(rows: DataFrame, splitters: list[tuple]) -> DataFrame:
    return rows.mapInArrow(_search(splitters), StructType([*rows.schema.fields, StructField("_r", IntegerType())]))


def _sums(rows: DataFrame, splitters: list[tuple]) -> dict[int, tuple[int, int]]:
    """Rows and bytes of each range that has any."""
    counted = _ranged(rows, splitters).groupBy("_r").agg(F.count(F.lit(1)), F.sum("size"))
    return {r: (n, size) for r, n, size in counted.collect()}


def splitters(rows: DataFrame, n_rows: int, size: int, shards: int) -> tuple[list[tuple], dict[int, tuple[int, int]]]:
    """Splitters of narrow rows, and rows and bytes of each range between them.

    No range is overfull, unless it is a single key; no group of equal texts that is to stay together is cut.
    """
    ranges = max(shards * PER_SHARD, -(-n_rows // RANGE_ROWS))
    fill = max(size // ranges, 1), max(n_rows // ranges, RANGE_ROWS // OVERFULL)
    found = _quantiles(_drawn(rows, F.lit(size / (ranges * OVERSAMPLE))), ranges)
    sums = _sums(rows, found)
    tried: set[tuple] = set()
    while True:
        bounds = [None, *found, None]
        over = {r: v for r, v in sums.items() if v[0] > 1 and (v[0] > OVERFULL * fill[1] or v[1] > OVERFULL * fill[0])}
        over = {r: v for r, v in over.items() if (bounds[r], bounds[r + 1]) not in tried}
        if not over:
            break
        tried |= {(bounds[r], bounds[r + 1]) for r in over}
        # A sample of each overfull range of its own, for as many parts as it has too much for.
        parts = {r: 1 + max(-(-s // fill[0]), -(-n // fill[1])) for r, (n, s) in over.items()}
        steps = F.create_map(*[F.lit(x) for r, (_, s) in over.items() for x in (r, s / (parts[r] * OVERSAMPLE))])
        sample: dict[int, list[tuple]] = {r: [] for r in over}
        for s in _drawn(_ranged(rows, found).where(F.col("_r").isin(list(over))), steps[F.col("_r")]):
            sample[bisect_right(found, s[:3])].append(s)
        more = {s for r, drawn in sample.items() if drawn for s in _quantiles(drawn, parts[r])}
        if more <= set(found):
            break
        found = sorted(more | set(found))
        sums = _sums(rows, found)
    cut = {s[0] for s in found if s[2] >= 0}
    if cut:
        groups = rows.where(F.col("_h").isin(list(cut))).groupBy("_h").agg(F.sum("size").alias("bytes")).collect()
        whole = {h for h, group in groups if group * KEEP * shards <= size}
        if whole:
            found = [s for s in found if s[2] < 0 or s[0] not in whole]
            sums = _sums(rows, found)
    return found, sums


@dataclass
class Plan:
    """What decides on every row: splitters, rows and bytes before each range, all bytes, and each shard's first row."""

    shards: int
    cuts: list[tuple]
    before: list[tuple[int, int, int]]
    size: int
    first: list[int]


def _placed(rows: DataFrame, plan: Plan) -> DataFrame:
    """Rows with their place among all rows and their shard."""
    spark = rows.sparkSession
    dealt = _ranged(rows, plan.cuts).repartition(min(partitions(spark), len(plan.cuts) + 1), "_r")
    ordered = Window.partitionBy("_r").orderBy("_h", "_k", "_p")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("_r", "_h")
    before = spark.createDataFrame(plan.before, "_r int, _rows long, _bytes long")
    placed = dealt.withColumns({"_row": F.row_number().over(ordered) - 1, "_byte": F.sum("size").over(upto) - F.col("size")})
    together = F.sum("size").over(group) * F.lit(KEEP * plan.shards) <= F.lit(plan.size)
    twice = F.when(together, 2 * F.min("_byte").over(group) + F.sum("size").over(group)).otherwise(2 * F.col("_byte") + F.col("size"))
    # A table of three numbers for each range.
    placed = placed.withColumn("_twice", twice).join(F.broadcast(before), "_r")
    shard = F.expr(f"cast((_twice + 2 * _bytes) * {plan.shards}L div {max(2 * plan.size, 1)}L as int)")
    return placed.withColumns({"_row": F.col("_row") + F.col("_rows"), "shard": shard})


def plan_shards(rows: DataFrame, shards: int) -> Plan:
    """Plan of narrow rows, from passes that bring only sums of ranges to the driver."""
    n_rows, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n_rows:
        return Plan(shards, [], [(0, 0, 0)], 0, [0] * shards)
    cuts, sums = splitters(rows, n_rows, size, shards)
    before, at = [], (0, 0)
    for r in range(len(cuts) + 1):
        before.append((r, *at))
        at = tuple(a + b for a, b in zip(at, sums.get(r, (0, 0))))
    plan = Plan(shards, cuts, before, size, [])
    first = dict(tuple(row) for row in _placed(rows, plan).groupBy("shard").agg(F.min("_row")).collect())
    plan.first = [first.get(s, 0) for s in range(shards)]
    return plan


def _assigned(rows: DataFrame, plan: Plan) -> DataFrame:
    first = F.array(*[F.lit(n).cast("long") for n in plan.first])
    return _placed(rows, plan).withColumn("slot", F.col("_row") - F.get(first, F.col("shard")))


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and place in it of every row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: shards have equal shares of all sizes, but for half a row, or half a group of equal texts of at
    most a hundredth of a shard, at either end. ``slot`` counts a shard's rows from 0 in the order of the key.
    """
    rows = checkpointed(_narrow(docs, key, text))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return _assigned(rows, plan_shards(rows, shards)).select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> None:
    """Whole rows as Parquet in a folder ``shard=...`` each, with their ``_slot``; texts are moved once, to their ranges."""
    plan = plan_shards(checkpointed(_narrow(docs, key, text)), shards)
    rows = _narrow(docs, key, text, F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_doc"))
    named = _assigned(rows, plan).select("_doc.*", F.col("slot").alias("_slot"), F.col("shard").alias("shard"))
    named.write.partitionBy("shard").parquet(path)
