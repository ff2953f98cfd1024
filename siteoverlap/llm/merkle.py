"""Merkle manifest of a dataset, its nodes labelled with the interval of leaf ranks they cover.

A row is a leaf; the rows of a tree (a value of one column) stand in order of their
id, and of two consecutive nodes one parent is made until one node, the subroot,
remains. The subroots in order of their trees are the leaves of one more tree, whose
root stands for the dataset. A node carries the half-open interval [lo, hi) of the
ranks of the leaves below it, so that

* an ancestor is a node whose interval contains another's: blocks of ``BAND`` levels
  are joined with the block above them on the bucket that an interval of that level
  falls into, from the root down, and no join looks at a leaf for each level;
* a sibling covers what is left of the parent's interval without the node's own.

Ranks come from one sort by ranges and the sizes of the ranges, so no task orders or
holds a tree; a block is at most 2^``BAND`` nodes, however large a tree is. Digests,
not texts, are shuffled, and texts are read once.

Null values have a mark of their own, so that null and "" differ; a tree may have a
null name (first in order), and its key is that mark or the marked name. Rows equal in tree and id, null ids (first) among them,
stand in order of their digests; repeated rows are leaves each. An empty table gives
an empty one. Only the named columns are read; others may have any name. Very long
texts are hashed where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textio import arrow_schema, bounded, small_batches, stored

#: Levels of a block: what one group of rows holds is at most 2^BAND nodes.
BAND = 8

NODES = "tree string, size long, level int, lo long, hi long, digest string"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_of(*values: Column) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def hashed(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def in_order(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """The rows (tree, ...) with rank (from 0, within their tree, in the given order) and size (rows of the tree).

    Rows are sorted by ranges of (tree, order) and stored; a rank is the place within
    the range and tree plus the rows of the ranges before. Only one row for each range
    and tree goes through a window.
    """
    columns = rows.columns
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    rows = stored(rows.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), name)
    ranges = rows.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("tree", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("size"))
    ranked = rows.join(bounded(ranges, f"{name}-ranges"), ["tree", "part"])
    return ranked.select(*columns, (F.col("before") + F.col("place") - F.col("first")).alias("rank"), "size")


def climbed(nodes: list[tuple[int, int, str]], levels: int) -> list[list[tuple[int, int, str]]]:
    """The nodes (lo, hi, digest) of a block and of ``levels`` levels above them; the last run of a level may be one node."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        runs = [below[k : k + 2] for k in range(0, len(below), 2)]
        out.append([(run[0][0], run[-1][1], hashed(*(d for _, _, d in run))) for run in runs])
    return out


def siblings(level: list[tuple[int, int, str]], parents: list[tuple[int, int, str]]) -> list[str]:
    """For each node what its parent's interval covers besides its own: the sibling as ``l:digest`` or ``r:digest``, "" if nothing is left."""
    at = {(lo, hi): digest for lo, hi, digest in level}
    out = []
    for k, (lo, hi, _) in enumerate(level):
        low, high, _ = parents[k // 2]
        out.append(f"l:{at[low, lo]}" if low < lo else f"r:{at[hi, high]}" if hi < high else "")
    return out


def in_blocks(table: DataFrame, level: int, *more: str) -> DataFrame:
    """tree, size, height (levels of the tree), bucket, nodes (lo, hi, digest and ``more``, in order): one row a block. table: the nodes of one level."""
    size = F.col("size")
    height = F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)
    rows = table.select("tree", "size", height.alias("height"), F.shiftright("lo", level + BAND).alias("bucket"), F.struct("lo", "hi", "digest", *more).alias("node"))
    return rows.groupBy("tree", "size", "height", "bucket").agg(F.array_sort(F.collect_list("node")).alias("nodes"))


def plain(nodes: list[dict]) -> list[tuple[int, int, str]]:
    return [(x["lo"], x["hi"], x["digest"]) for x in nodes]


def grown(leaves: DataFrame, name: str, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of the levels 0 (with the columns ``more``), BAND, 2 BAND, ..., and the table of all nodes (NODES). leaves: tree, rank, size, digest, ``more``."""
    spark = leaves.sparkSession
    small_batches(spark)
    arrow = arrow_schema(spark.createDataFrame([], NODES).schema)
    tables = [leaves.select("tree", "size", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", *more)]
    every = tables[0].select("tree", "size", F.lit(0).alias("level"), "lo", "hi", "digest")
    largest = leaves.agg(F.max("size")).first()[0] or 0
    for level in range(0, max(0, largest - 1).bit_length(), BAND):

        def climb(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    levels = climbed(plain(r["nodes"]), min(BAND, r["height"] - level))
                    rows = [(r["tree"], r["size"], k, *node) for k, some in enumerate(levels[1:], level + 1) for node in some]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        made = stored(in_blocks(tables[-1], level).where(F.col("height") > level).mapInArrow(climb, NODES), f"{name}-nodes")
        every = every.unionByName(made)
        tables.append(made.where(F.col("level") == level + BAND).drop("level"))
    return tables, every


def subroots(nodes: DataFrame) -> DataFrame:
    """The nodes that cover the whole of their tree."""
    return nodes.where((F.col("lo") == 0) & (F.col("hi") == F.col("size")))


def paths(tables: list[DataFrame], name: str, *more: str) -> DataFrame:
    """tree, lo, hi, digest, ``more`` of the leaves, and steps: their siblings level by level, nearest first. tables: as of ``grown``.

    From the top down, a block is joined with the node above that contains it, by the
    bucket of that node's level, and takes over its steps.
    """
    none, above = F.array().cast("array<string>"), None
    for k in reversed(range(len(tables))):
        level, extra = k * BAND, more if k == 0 else ()
        own = in_blocks(tables[k], level, *extra)
        if above is None:
            own = own.withColumn("higher", none)
        else:
            up = above.select("tree", F.shiftright("lo", level + BAND).alias("bucket"), F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"), F.col("steps").alias("higher"))
            inside = F.col("up_lo").isNull() | ((F.col("up_lo") <= F.col("nodes")[0]["lo"]) & (F.element_at("nodes", -1)["hi"] <= F.col("up_hi")))
            own = own.join(up, ["tree", "bucket"], "left").where(inside).withColumn("higher", F.coalesce("higher", none))
        own = own.select("tree", "height", "nodes", "higher")
        schema = own.select("tree", F.explode("nodes").alias("node"), F.col("higher").alias("steps")).select("tree", "node.*", "steps").schema

        def attach(batches: Iterator[pa.RecordBatch], level: int = level, arrow: pa.Schema = arrow_schema(schema)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    levels = climbed(plain(r["nodes"]), min(BAND, r["height"] - level))
                    beside = [siblings(a, b) for a, b in zip(levels[:-1], levels[1:], strict=True)]
                    rows = [{"tree": r["tree"], **x, "steps": [b[i >> j] for j, b in enumerate(beside)] + r["higher"]} for i, x in enumerate(r["nodes"])]
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

        above = own.mapInArrow(attach, schema)
        above = stored(above, f"{name}-steps") if k else above
    return above


def folded(digest: Column, steps: Column) -> Column:
    """The root that follows from a digest and its siblings."""

    def parent(below: Column, step: Column) -> Column:
        side, other = F.substring(step, 1, 1), F.substring(step, 3, 64)
        return F.sha2(F.concat(F.when(side == "l", other).otherwise(""), below, F.when(side == "r", other).otherwise("")), 256)

    return F.aggregate(steps, digest, parent)


def proof_digest(steps: Column) -> Column:
    """The digest of all siblings, level by level."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.substring(s, 3, 64)), ""), 256)


def leaves_of(rows: DataFrame, tree: Column, order: Column, digest: Column, again: Column | None = None) -> DataFrame:
    """What ``manifest`` takes: tree (its marked name), id, digest and again, the digest of a row as it is found later (null: the same)."""
    other = again if again is not None else F.lit(None).cast("string")
    return rows.select(field(tree).alias("tree"), order.alias("id"), digest.alias("digest"), other.alias("again"))


def manifest(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of all trees (NODES; the tree over the subroots is ""), and a row a leaf: tree, id, digest, again, subroot, root, steps.

    steps are the siblings up to the root, as ``l:digest``, ``r:digest`` or "" where a
    node was alone in its run.
    """
    ranked = in_order(stored(leaves, "leaves"), "ranked", "id", "digest")
    tables, nodes = grown(ranked, "tree", "id", "again")
    name = F.when(F.col("tree") != "-", F.regexp_extract("tree", r"(?s)^[0-9]+:(.*)$", 1))
    tops = in_order(subroots(nodes).select(F.lit("").alias("tree"), F.col("tree").alias("of"), name.alias("name"), "digest"), "subroots", "name")
    top_tables, top_nodes = grown(tops, "top", "of")
    root = subroots(top_nodes).first()
    over = paths(top_tables, "top", "of").select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), F.col("steps").alias("over"))
    proofs = paths(tables, "tree", "id", "again").join(bounded(over, "over"), "tree")
    proofs = proofs.select("tree", "id", "digest", "again", "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), F.concat("steps", "over").alias("steps"))
    return nodes.unionByName(top_nodes), proofs
