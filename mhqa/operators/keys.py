"""Keys, order and joins: ordinals, latest rows, gates, positional and exact joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mhqa.runtime import materialise


class ContractError(ValueError):
    """A gate that the data must pass before anything is published has failed."""


def gate(df: DataFrame, **conditions: Column) -> dict[str, int]:
    """Counts of the rows that break each condition, in one pass; ContractError if any does. A null condition counts as broken."""
    row = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()]).first().asDict()
    if broken := {n: k for n, k in row.items() if k}:
        raise ContractError(f"broken: {broken}")
    return row


def require_empty(df: DataFrame, what: str, *show: str) -> None:
    """ContractError with up to five examples if ``df`` has rows."""
    if rows := df.select(*show).limit(5).collect():
        raise ContractError(f"{what}: {[tuple(r) for r in rows]}")


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key: the last by ``order``, which must settle ties."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of the keys that occur more than once; null keys count as equal."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def with_ordinal(df: DataFrame, *order: str, into: str = "ordinal") -> DataFrame:
    """``df`` with the rank of each row, from 0 without gaps, by the total order ``order``.

    The rows are range-partitioned and numbered within their partitions; the partitions' sizes, one small row each, give the offsets. No task
    sees more than its range. The ranges are written first, because range bounds come from samples and would differ when computed again.
    """
    ranged = materialise(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__size"))
    offsets = sizes.select("__p", (F.coalesce(F.sum("__size").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__offset"))  # one row for each partition
    inner = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return ranged.withColumn("__i", inner).join(F.broadcast(offsets), "__p").withColumn(into, F.col("__i") + F.col("__offset")).drop("__p", "__i", "__offset")


def is_contiguous(df: DataFrame, ordinal: str) -> DataFrame:
    """(n, first, last, contiguous): whether the ordinals run from 0 without gap or repetition."""
    return df.agg(F.count("*").alias("n"), F.min(ordinal).alias("first"), F.max(ordinal).alias("last"), F.countDistinct(ordinal).alias("d")).select(
        "n", "first", "last", ((F.col("n") == 0) | (F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("d") == F.col("n"))).alias("contiguous")
    )


def positional_join(left: DataFrame, right: DataFrame, *, left_order: Sequence[str], right_order: Sequence[str], group: int, strict: bool = True) -> DataFrame:
    """Each row of ``left``, in order, with the ``group`` consecutive rows of ``right`` that belong to it.

    The columns of both, ``ordinal`` (of the left row) and ``member`` (0 … group - 1). With ``strict`` a surplus or shortfall on either side is a
    ContractError; else the missing side is null.
    """
    if strict and (n := left.count()) * group != (m := right.count()):  # ordinals have no gaps, so the counts tell all
        raise ContractError(f"rows don't fit the groups: {n} times {group} on the left, {m} on the right")
    a = with_ordinal(left, *left_order)
    b = with_ordinal(right, *right_order, into="__row").withColumns({"ordinal": F.floor(F.col("__row") / group).cast("long"), "member": (F.col("__row") % group).cast("int")}).drop("__row")
    return a.withColumn("ordinal", F.col("ordinal").cast("long")).join(b, "ordinal", "inner" if strict else "full")


def exact_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The inner join, after a check that neither side has a key that the other lacks."""
    require_empty(left.join(right, keys, "left_anti"), "missing on the right", *keys)
    require_empty(right.join(left, keys, "left_anti"), "unused on the right", *keys)
    return left.join(right, keys)


def pending(inputs: DataFrame, completed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The inputs that aren't completed; completed keys that no input has are a ContractError."""
    require_empty(completed.join(inputs, keys, "left_anti"), "completed without input", *keys)
    return inputs.join(completed, keys, "left_anti")


def ordered_digest(df: DataFrame, line: Column, ordinal: str, *, chunk: int = 1000) -> DataFrame:
    """(n, digest): a digest that depends on the order of the rows. Chunks of consecutive lines are hashed, then the chunks' digests in order, so no task holds all lines."""
    chunks = df.select(F.floor(F.col(ordinal) / chunk).alias("c"), F.struct(F.col(ordinal).alias("o"), line.alias("l")).alias("x")).groupBy("c").agg(F.count("*").alias("n"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat(x["l"], F.lit("\n")))), 256).alias("d"))
    top = chunks.agg(F.max("c")).first()[0] or 0
    while top >= chunk:  # a tree of digests, so that the last task gets no more than a chunk of them
        chunks = chunks.select(F.floor(F.col("c") / chunk).alias("k"), "c", "n", "d").groupBy("k").agg(F.sum("n").alias("n"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("c", "d"))), lambda x: x["d"])), 256).alias("d")).withColumnRenamed("k", "c")
        top //= chunk
    return chunks.agg(F.sum("n").alias("n"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("c", "d"))), lambda x: x["d"])), 256).alias("digest"))
