"""Connected components over an edge table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, block_tasks, splittable


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with v < u."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
    large = edges.join(splittable(least), "v").select("u", F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    near = large.join(splittable(low), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.expr("bit_xor(xxhash64(v, u))")).first())


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b, both long).

    Component is the smallest node reachable. Alternates large-star and
    small-star steps (Kiveris et al., "Connected Components in MapReduce and
    Beyond") until the edges are stars around their smallest node. Each round
    is two aggregates with map-side combine and two joins whose sides are both
    dealt out for them, so that AQE can split them at hot hubs; the edge table is written between rounds, so nothing is collected
    and a lost executor costs one round at most. Null ends and loops are
    ignored; no edges give no rows.
    """
    now = scratch.table(
        edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        after = scratch.table(_stars(now), "edges")
        changed = _state(after)
        scratch.drop(now)
        now, same = after, changed == state
        state = changed
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def spanning_links(spark: SparkSession, scratch: Scratch, rows: DataFrame, keys: list[str], row_id: str, payload: str, size: str, weight: Column, block: int, largest: int | None, joiner) -> DataFrame:
    """(a, b): links of ``row_id`` that connect what the links of each group connect.

    ``rows`` has the columns ``keys`` of a group, ``size`` (sum of ``weight`` over
    the group), a row's id and its payload; ``largest`` is the largest size.
    ``joiner`` takes batches sorted by group (keys, bi, bj, id, payload, comp) and
    gives links such that rows of each group are connected as by all its links,
    rows of one ``comp`` counting as connected.

    Groups of up to ``block`` are a task each. A larger one goes out in blocks,
    each row once; then one row of each component of each block meets those of
    the other blocks. After that, all rows but those of the group's largest
    component are still to meet all rows of the others: they go out, block by
    block, against the group's blocks. So a mass of near copies moves a few times
    its rows, whatever its size; only rows that stay apart from it meet all of it.
    """
    deal = [*keys, "bi", "bj"]
    out = [*deal, row_id, payload, "comp"]

    def linked(tasks: DataFrame, name: str) -> DataFrame:
        return scratch.table(tasks.select(*out).mapInArrow(joiner, "a long, b long").distinct(), name)

    blocks = lambda total: F.greatest(F.lit(1), F.ceil(total / F.lit(block))).cast("int")
    block_of = lambda n, salt: F.pmod(F.xxhash64(F.col(row_id), F.lit(salt)), n).cast("int")
    if (largest or 0) <= block:
        one = rows.withColumns({"bi": F.lit(0), "bj": F.lit(0), "comp": F.col(row_id)})
        return linked(one.repartition(*keys).sortWithinPartitions(*keys), "links")
    rows = scratch.table(rows, "rows")
    placed = rows.withColumn("bi", block_of(blocks(F.col(size)), 7)).withColumns({"bj": F.col("bi"), "comp": F.col(row_id)})
    links = linked(placed.repartition(*deal).sortWithinPartitions(*deal), "links")

    def crowd() -> DataFrame:
        """Rows of the groups over a block, with the component they are in so far."""
        known = connected_components(spark, links, scratch).withColumnRenamed("node", row_id)
        large = placed.where(F.col(size) > block).select(*keys, "bi", row_id, payload, size, weight.alias("_w"))
        return scratch.table(large.join(known, row_id, "left").withColumn("comp", F.coalesce("component", row_id)).drop("component"), "crowd")

    few = crowd().groupBy(*keys, "bi", "comp").agg(F.min(row_id).alias(row_id), F.min_by(payload, row_id).alias(payload), F.min_by("_w", row_id).alias("_w"))
    few = scratch.table(few.drop("bi"), "representatives")
    few = few.join(splittable(few.groupBy(*keys).agg(F.sum("_w").alias("_total"))), keys)
    links = scratch.table(links.unionByName(linked(block_tasks(few, "_total", block, row_id, keys), "across")).distinct(), "links")
    all_rows = crowd()
    main = all_rows.groupBy(*keys, "comp").agg(F.sum("_w").alias("_w")).groupBy(*keys).agg(F.max_by("comp", F.struct("_w", "comp")).alias("_main"), (F.sum("_w") - F.max("_w")).alias("_rest"), F.sum("_w").alias("_total"))
    open_ = scratch.table(main.where("_rest > 0").select(*keys, "_main", blocks(F.col("_rest")).alias("_k"), blocks(F.col("_total")).alias("_n")), "open")
    if not open_.take(1):
        return links
    still = all_rows.join(open_, keys)
    rest = still.where(F.col("comp") != F.col("_main")).withColumn("bi", block_of(F.col("_k"), 11)).withColumn("bj", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    whole = still.withColumn("bj", block_of(F.col("_n"), 7)).withColumn("bi", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    tasks = rest.select(*out).unionByName(whole.select(*out)).repartition(*deal).sortWithinPartitions(*deal)
    return links.unionByName(linked(tasks, "rest"))
