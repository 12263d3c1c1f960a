"""Decision trees over the neighbourhood of samples: properties as columns, traversal as one nested expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import pixel
from tessera.operators.raster import neighbours, whole_images

#: Nodes that a tree may have: it becomes one expression.
MOST_NODES = 4096


def properties(df: DataFrame, channel: int = 0, stream: int = 0, max_error: Column | None = None) -> DataFrame:
    """Rows (image, x, y, v) with p0 .. p15: channel, stream, place, and differences of the neighbours of each sample.

    p8 compares the sample to the west with the gradient at its own place; max_error is that of a self-correcting
    predictor, 0 without one.
    """
    rows = neighbours(df)
    w, n, nw, ne, nn, ww = (F.col(c) for c in ("w", "n", "nw", "ne", "nn", "ww"))
    before = F.lag(w + n - nw).over(Window.partitionBy("image", "y").orderBy("x"))
    values = [F.lit(channel), F.lit(stream), F.col("y"), F.col("x"), F.abs(n), F.abs(w), n, w, w - F.coalesce(before, F.lit(0)), w + n - nw, w - nw, nw - n, n - ne, n - nn, w - ww, F.lit(0) if max_error is None else max_error]
    return rows.select(*df.columns, *[v.cast("bigint").alias(f"p{k}") for k, v in enumerate(values)])


def earlier_properties(df: DataFrame, other: DataFrame, first: int = 16) -> DataFrame:
    """df with four properties of an earlier channel (image, x, y, v) at the same place: its size, itself, and its distance
    to the gradient of its own neighbours, as size and as it is. Places that the other lacks count as 0."""
    rows = whole_images(other)
    row, col = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    rows = rows.withColumn("_w", F.coalesce(F.lag("v").over(row), F.lit(0))).withColumn("_up", F.lag("v").over(col))
    rows = rows.withColumn("_n", F.coalesce("_up", "_w")).withColumn("_nw", F.coalesce(F.lag("_up").over(row), "_w"))
    apart = F.col("v") - pixel.gradient(F.col("_w"), F.col("_n"), F.col("_nw"))
    made = rows.select("image", "x", "y", F.col("v").alias("_c"), apart.alias("_g"))
    out = df.join(made, ["image", "x", "y"], "left")
    c, g = F.coalesce(F.col("_c"), F.lit(0)).cast("bigint"), F.coalesce(F.col("_g"), F.lit(0)).cast("bigint")
    return out.withColumns({f"p{first}": F.abs(c), f"p{first + 1}": c, f"p{first + 2}": F.abs(g), f"p{first + 3}": g}).drop("_c", "_g")


@dataclass(frozen=True)
class Node:
    """A decision (property above value: left, else right) or, with property None, a leaf with its values."""

    property: int | None
    value: int = 0
    left: int = 0
    right: int = 0
    leaf: tuple[int, ...] = ()


def traverse(nodes: Sequence[Node], fields: Sequence[str] = ("context", "predictor", "offset", "multiplier")) -> Column:
    """Struct of the leaf that each row's properties reach, from node 0 down. Children come after their parents."""
    if len(nodes) > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes")
    made: dict[int, Column] = {}
    for k in range(len(nodes) - 1, -1, -1):
        node = nodes[k]
        if node.property is None:
            made[k] = F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, node.leaf, strict=True)])
        elif min(node.left, node.right) <= k or max(node.left, node.right) >= len(nodes):
            raise ValueError(f"node {k} has no such child")
        else:
            made[k] = F.when(F.col(f"p{node.property}") > node.value, made[node.left]).otherwise(made[node.right])
    return made[0]
