"""Running totals and ordered concatenation that no single task has to carry.

A window over a group puts the whole group into one task. Here the rows are cut into
ranges of their order first, so a group of any size spreads over many tasks; what the
ranges before hold is added from a table with one row per group and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.session import cut

# Bytes of one assembled cell. Far below the 2 GB a string may have.
PART_BYTES = 64 << 20


def running_totals(df: DataFrame, group: list[str], order: list[str], totals: dict[str, str]) -> DataFrame:
    """For each ``value: name``, add ``name``: the values of the group's rows before.

    ``df`` should hold slim rows: it is written once to the shared folder, because the
    ranges must be the same each time they are read.
    """
    placed = df.repartitionByRange(*group, *order).withColumn("_slice", F.spark_partition_id())
    placed = cut(placed)
    # One row per group and range: at most groups + ranges rows in all.
    slices = placed.groupBy(*group, "_slice").agg(*[F.sum(v).alias(f"_n_{v}") for v in totals])
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def before(value: str, window) -> Column:
        return F.coalesce(F.sum(value).over(window), F.lit(0))

    slices = slices.select(*group, "_slice", *[before(f"_n_{v}", earlier).alias(f"_b_{v}") for v in totals])
    inside = placed.select("*", *[before(v, above).alias(f"_i_{v}") for v in totals])
    sums = [(F.col(f"_b_{v}") + F.col(f"_i_{v}")).alias(name) for v, name in totals.items()]
    return inside.join(slices, [*group, "_slice"]).select(*df.columns, *sums)


def stitch(
    pieces: DataFrame,
    group: list[str],
    order: list[str],
    text: str,
    name: str,
    part_bytes: int = PART_BYTES,
    keep: bool = False,
) -> DataFrame:
    """Concatenate the pieces of each group in order: ``(*group, part, name)``.

    A part ends once it holds ``part_bytes``; the parts of a group, put together in
    order, are the whole text. Groups below the limit have the one part 0, and if all
    are, the parts need not be worked out. Pieces of equal order are ordered by a hash
    of their text, and equal ones stay together, whatever ``part_bytes`` is. Pieces are
    made twice, for their sizes and for their text; ``keep`` has them written to the
    shared folder, for short ones that are costly to make.
    """
    pieces = pieces.withColumn("_tie", F.xxhash64(text))
    pieces = cut(pieces) if keep else pieces
    order = [*order, "_tie"]
    sizes = pieces.groupBy(*group, *order).agg(F.sum(F.octet_length(text)).cast("bigint").alias("_bytes"))
    sizes = cut(sizes)
    totals = sizes.groupBy(*group).agg(F.sum("_bytes").alias("_bytes"))
    if totals.where(F.col("_bytes") > part_bytes).isEmpty():
        parted = pieces.withColumn("part", F.lit(0).cast("bigint"))
    else:
        placed = running_totals(sizes, group, order, {"_bytes": "_before"})
        part = F.expr(f"_before div {int(part_bytes)}")
        placed = placed.select(*group, *order, part.alias("part"))
        parted = pieces.join(placed, [*group, *order])
    return parted.groupBy(*group, "part").agg(joined(text, order).alias(name))


def joined(text: str | Column, order: list[str], sep: str = "") -> Column:
    """Texts of a bounded group, joined in order."""
    held = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text") if isinstance(text, str) else text.alias("_text"))))
    return F.array_join(F.transform(held, lambda s: s["_text"]), sep)
