"""Order of units inside containers nested to any depth.

A document is a table of nodes: an id, the id of the container that holds it and
the step that leads there (kind, row, cell, paragraph as numbers).  A node's
place in the walk is the list of steps from the document down to it; lists
compare step by step, so a container's paragraphs come before its cells, and a
cell with all that it holds before the next cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored

#: containers inside each other; more is taken for a cycle
MAX_DEPTH = 1024


def container_paths(nodes: DataFrame, scope_cols: list[str], id_col: str, parent_col: str, step_cols: list[str],
                    path_col: str = "path", max_depth: int = MAX_DEPTH, wanted: str | None = None) -> DataFrame:
    """``nodes`` with ``path_col``, an array of bigint that sorts in walk order;
    use it as ``order_col`` of ``mask``.  ``wanted``: a condition on the nodes that
    the result is to have; all of them are followed and checked.

    Only containers that hold something are followed.  Every round joins each open
    path with the path of the container that it starts at, so its length doubles: a
    depth of d takes log2(d) joins; what has reached the document is not joined
    again.  Nodes then take the path of their container in one join.  A null parent,
    or one that is not among the nodes, is the document itself.  Null steps come
    before 0, repeated ids of one scope are an error, and so are cycles (paths of
    more than ``max_depth`` steps)."""
    spark = nodes.sparkSession
    clash = {path_col, "_path", "_up", "_id", "_scope", "_before", "_s", "_i"} & set(nodes.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken")
    step = F.array(*[F.coalesce(F.col(c).cast("bigint"), F.lit(-1).cast("bigint")) for c in step_cols])
    scope = F.struct(*[F.col(c) for c in scope_cols]) if scope_cols else F.struct(F.lit(0))
    written: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        out, path = stored(df)
        written.append(path)
        return out

    links = kept(nodes.select(scope.alias("_scope"), F.col(id_col).alias("_id"), F.col(parent_col).alias("_up"), step.alias("_path")))
    if not links.groupBy("_scope", "_id").count().where("count > 1").isEmpty():
        raise ValueError("node ids repeat within a document")
    holders = links.where("_up IS NOT NULL").select(F.col("_scope").alias("_s"), F.col("_up").alias("_i")).distinct()
    inner = kept(links.join(holders, F.col("_scope").eqNullSafe(F.col("_s")) & (F.col("_id") == F.col("_i")), "left_semi"))
    discard(spark, written.pop(0))  # the links: what is followed has been written
    done, still = inner.where("_up IS NULL"), inner.where("_up IS NOT NULL")
    while not still.isEmpty():
        if not still.where(F.size("_path") > (max_depth - 1) * len(step_cols)).isEmpty():  # each of them holds one more
            raise ValueError(f"containers lie more than {max_depth} deep or in a cycle")
        above = done.unionByName(still).select(F.col("_scope").alias("_s"), F.col("_id").alias("_i"), F.col("_up").alias("_next"), F.col("_path").alias("_before"))
        longer = kept(still.join(above, F.col("_scope").eqNullSafe(F.col("_s")) & (F.col("_up") == F.col("_i")), "left")
                      .select("_scope", "_id", F.col("_next").alias("_up"), F.concat(F.coalesce("_before", F.array().cast("array<bigint>")), "_path").alias("_path")))
        done, still = done.unionByName(longer.where("_up IS NULL")), longer.where("_up IS NOT NULL")
    if not done.where(F.size("_path") > (max_depth - 1) * len(step_cols)).isEmpty():
        raise ValueError(f"containers lie more than {max_depth} deep or in a cycle")
    above = done.select(F.col("_scope").alias("_s"), F.col("_id").alias("_i"), F.col("_path").alias("_before"))
    out, _ = stored((nodes.where(wanted) if wanted else nodes).join(above, scope.eqNullSafe(F.col("_s")) & (F.col(parent_col) == F.col("_i")), "left")
                    .select(*nodes.columns, F.concat(F.coalesce("_before", F.array().cast("array<bigint>")), step).alias(path_col)))
    for path in written:
        discard(spark, path)
    return out
