"""Merkle manifest of a dataset (operator 11), DataFrame functions only.

Rows become leaves: the hash of all their columns, each written with its length.  The
leaves of a tree (one for each value of a column, say the source) are put in order,
and every run of `arity` neighbours becomes their hash, level by level, until one node
is left; the trees' last nodes, in the order of their names, make the tree above them
in the same way, whose last node is the root of the dataset.

Every level is one job: the nodes, numbered within their trees, equijoin the nodes of
the same level at the numbers of their siblings (the number with its lowest bit
flipped in a binary tree, else the other slots of the run), and the rows in slot zero,
which know their whole run then, emit the parents.  All trees climb together, whatever
their sizes, so a tree that holds a third of all rows is spread like any other.  The
paths come down again in one chain of joins from the root to the leaves, each of a
level with the one above.

A row's proof is its path: for each level the hashes that stand left and right of its
own.  Folding a leaf with them gives the root, if the row is as it was.

Nulls: a null value hashes as `-`; a null tree is a tree of its own before all others,
the empty name included; null ids come first.  Rows with equal ids are ordered by
their leaves, so repeated rows are equal leaves with places of their own.  Long texts
are hashed whole and never moved.  An empty table has no rows and no root.  Columns
that are not named are left out, whatever they are called.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import stored

#: (all that stands left, all that stands right) of a node in its run, from the leaf up.
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes, so that neighbours cannot trade bytes; `-` for null."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The hash of a row's values."""
    return digest(*map(field, values))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda own, run: digest(run["left"], own, run["right"]))


def siblings(path: Column) -> Column:
    """All hashes of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda run: F.concat(run["left"], run["right"])), "")


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """`rows` with their number in their tree, from 0, and how many the tree has.

    Spark sorts all rows by tree and order; a part's places and a sum over the parts of each tree number them, so
    no task holds a tree.
    """
    placed = stored(rows.orderBy(tree, *order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    own = Window.partitionBy(tree)
    parts = parts.withColumns({
        "_before": F.sum("_rows").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows"),
        "n_nodes": F.sum("_rows").over(own),
    })
    number = F.col("_before") + F.col("_at") - F.col("_first")
    return placed.join(parts, [tree, "_part"]).withColumn("number", number).drop("_at", "_part", "_first", "_rows", "_before")


def _sibling_numbers(arity: int) -> list[Column]:
    """The numbers of a node's siblings, ascending."""
    number = F.col("number")
    if arity == 2:
        return [number.bitwiseXOR(F.lit(1))]
    slot = number % arity
    return [number - slot + k + F.when(slot <= k, 1).otherwise(0) for k in range(arity - 1)]


def level(nodes: DataFrame, arity: int) -> DataFrame:
    """`nodes` (tree, number, digest, ...) with what stands left and right of each in its run."""
    others = nodes.select("tree", F.col("number").alias("_other"), F.col("digest").alias("_digest"))
    out = nodes.withColumns({f"_at{k}": at for k, at in enumerate(_sibling_numbers(arity))})
    for k in range(arity - 1):
        out = out.join(others.withColumnsRenamed({"_other": f"_at{k}", "_digest": f"_d{k}"}), ["tree", f"_at{k}"], "left")
    slot = F.col("number") % arity
    side = lambda there: F.concat(*[F.when(there(k), F.coalesce(f"_d{k}", F.lit(""))).otherwise("") for k in range(arity - 1)])
    return out.select(*nodes.columns, side(lambda k: slot > k).alias("left"), side(lambda k: slot <= k).alias("right"))


def climb(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The written levels of all trees from the bottom up, and (tree, digest, height) of each tree's last node."""
    most = nodes.agg(F.max("n_nodes")).first()[0] or 0
    levels, last = [], []
    while True:
        last.append(nodes.filter("n_nodes = 1").select("tree", "digest", F.lit(len(levels)).alias("height")))
        if most <= 1:
            return levels, reduce(DataFrame.unionByName, last)
        levels.append(stored(level(nodes.filter("n_nodes > 1"), arity)))
        up = lambda c: F.floor((F.col(c) + arity - 1) / arity)
        first = levels[-1].filter(F.col("number") % arity == 0)
        nodes = first.select("tree", up("number").alias("number"), up("n_nodes").alias("n_nodes"), digest(F.col("digest"), F.col("right")).alias("digest"))
        most = -(-most // arity)


def descend(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame | None:
    """The bottom level's rows with path and subroot, from (tree, height, path, subroot) of the last nodes; None without levels."""
    below = None
    for height in range(len(levels), 0, -1):
        # the nodes of this height: last nodes of their trees, and those with a level above
        parents = tops.filter(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("_parent"), "path", "subroot")
        if below is not None:
            parents = parents.unionByName(below.select("tree", F.col("number").alias("_parent"), "path", "subroot"))
        rows = levels[height - 1].withColumn("_parent", F.floor(F.col("number") / arity)).join(parents.withColumnRenamed("path", "_above"), ["tree", "_parent"])
        below = rows.withColumn("path", F.concat(F.array(F.struct("left", "right")), "_above")).drop("_parent", "_above", "left", "right")
    return below


def manifest(rows: DataFrame, columns: list[str], id_col: str, tree_col: str, arity: int = 3, carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, tree, leaf, number, n_nodes, path, subroot, root) of every row, and what `carry` names.

    `number` is the row's place in its tree, `path` its proof (see PATH), from the leaf by its tree's last node
    (`subroot`) to the root. Hashes of what `carry` computes from a row may be folded with the same path.
    """
    carry = carry or {}
    name = F.when(F.col(tree_col).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(tree_col).cast("string")))  # in order: null, then by bytes
    leaves = rows.select(name.alias("tree"), F.col(id_col).alias("_id"), leaf(*map(F.col, columns)).alias("digest"), *[c.alias(f"_c_{k}") for k, c in carry.items()])
    bottom = stored(numbered(stored(leaves), "tree", ["_id", "digest"]))
    levels, tops = climb(bottom, arity)
    tops = stored(numbered(stored(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", "height")), "tree", ["name"]).withColumnRenamed("height", "_height"))
    upper, top = climb(tops, arity)
    root = top.first()  # one row, or none
    ends = top.select("tree", "height", F.array().cast(PATH).alias("path"), F.col("digest").alias("subroot"))
    paths = descend(upper, ends, arity)
    paths = paths if paths is not None else tops.withColumn("path", F.array().cast(PATH))
    trees = stored(paths.select(F.col("name").alias("tree"), F.col("_height").alias("height"), "path", F.col("digest").alias("subroot")))
    lone = bottom.filter("n_nodes = 1").join(trees.select("tree", "path", "subroot"), "tree")
    found = descend(levels, trees, arity)
    found = lone if found is None else found.select(lone.columns).unionByName(lone)
    out = found.select(F.col("_id").alias(id_col), F.when(F.col("tree") != "-", F.substr("tree", F.lit(2))).alias("tree"), F.col("digest").alias("leaf"), "number", "n_nodes", "path", "subroot", *[F.col(f"_c_{k}").alias(k) for k in carry])
    return out.withColumn("root", F.lit(root["digest"] if root else None).cast("string"))


def proofs(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of `documents` by source, three nodes a run.

    Where 2 divides the unsigned CRC-32 of the decimal id, the row is tampered with: its text loses its line breaks.
    A null id is never tampered with.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = leaf(*[F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in columns])
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    rows = manifest(docs, columns, "doc_id", "source", 3, {"tampered": F.when(chosen, tampered)})
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
