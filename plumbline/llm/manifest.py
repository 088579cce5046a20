"""Merkle manifest of a dataset, with proofs that are folded from copied hash states.

Every row is a leaf. The leaves of a group, in order of their ids, form a tree whose parents hash runs
of ``FAN`` children; the roots of the groups, in order of the groups, form a tree of the same kind.

A parent keeps a copy of its hash state before each child slot. To fold a leaf upward, the state kept
for its slot is copied and takes the replacement and the right siblings only: what stands left of the
slot is never hashed again. Below the root of a block the states stay in the memory of the task that
built it; what lies above is the same for a whole block, whose task makes each state once from the
left siblings.

Trees are built by blocks of ``FAN ** LEVELS`` consecutive nodes, one small group of rows each, then
by blocks of the blocks' roots, until a group has one node: passes grow with the logarithm of the
largest group. No task holds more than a block, and only the number of passes reaches the driver.

Defined results: a null field enters as ``-``; groups may be null (first in order); null ids come
first, rows of one id in order of their leaves, equal rows in any order (their leaves are the same);
an empty table has no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

FAN = 2
LEVELS = 10             # levels of a block: up to 1024 nodes in a task's group
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: list[Column]) -> Column:
    """sha256 of the fields in turn, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    parts = []
    for c in fields:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame, replaced: dict[str, Column] | None = None, where: Column | None = None,
           fields: tuple = FIELDS, id_column: str = "doc_id", group: str = "lang") -> DataFrame:
    """(id, g, leaf, other): ``other`` is the leaf with ``replaced`` fields where the condition holds, else null."""
    other = F.lit(None).cast("string")
    if replaced:
        other = leaf([replaced.get(c, F.col(c)) for c in fields])
        other = other if where is None else F.when(where, other)
    return docs.select(F.col(id_column).alias("id"), F.col(group).alias("g"),
                       leaf([F.col(c) for c in fields]).alias("leaf"), other.alias("other"))


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with pos, their place from 0 within the group, and total, the group's rows.

    Rows are sorted by ranges, which may cut groups anywhere, and written once. A row's place is its
    place in its part of the group plus the sizes of the parts before.
    """
    sort = [F.asc_nulls_first(c) for c in [group, *order]]
    ranged = stored(rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
                    .withColumn("__at", F.monotonically_increasing_id())
                    .withColumn("__part", F.spark_partition_id()))
    parts = ranged.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    whole = Window.partitionBy("__g")
    before = whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__g", "__p", "__first", F.sum("__n").over(whole).alias("total"),
                         F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = ranged[group].eqNullSafe(parts["__g"]) & (ranged["__part"] == parts["__p"])
    return (ranged.join(parts, same)
            .withColumn("pos", F.col("__at") - F.col("__first") + F.col("__before"))
            .drop("__at", "__part", "__g", "__p", "__first", "__before"))


class Block:
    """The tree over a block of nodes: ``levels[i]`` has the hash states and children of each parent."""

    def __init__(self, nodes: list[bytes], total: int):
        self.levels = []
        # A block that is not its whole group is lifted all levels, single nodes too.
        while len(self.levels) < LEVELS and (len(nodes) > 1 or total > FAN ** LEVELS):
            parents = []
            for start in range(0, len(nodes), FAN):
                state, kept, run = hashlib.sha256(), [], nodes[start:start + FAN]
                for child in run:
                    kept.append(state.copy())
                    state.update(child)
                parents.append((kept, run, state))
            self.levels.append(parents)
            nodes = [state.hexdigest().encode() for _, _, state in parents]
        self.root = nodes[0]

    def path(self, i: int) -> list[tuple]:
        """(state before the slot, left siblings, right siblings) of the i-th node, upwards."""
        steps = []
        for parents in self.levels:
            i, slot = divmod(i, FAN)
            kept, run, _ = parents[i]
            steps.append((kept[slot], b"".join(run[:slot]), b"".join(run[slot + 1:])))
        return steps


def fold(node: bytes, steps: list[tuple]) -> bytes:
    """The root that a replaced node gives: each step resumes the state kept before the node's slot."""
    for state, _, rights in steps:
        state = state.copy()
        state.update(node)
        state.update(rights)
        node = state.hexdigest().encode()
    return node


def _block_of() -> Column:
    return F.floor(F.col("pos") / FAN ** LEVELS).cast("long")


def lifted(nodes: DataFrame, digest: str) -> DataFrame:
    """(g, pos, total, digest): the roots of the blocks, as nodes of the next pass."""
    block, size = Block, FAN ** LEVELS
    kind = nodes.schema["g"].dataType.simpleString()

    def up(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        total = int(rows["total"].iloc[0])
        tree = block([x.encode() for x in rows["digest"]], total)
        return pd.DataFrame({"g": rows["g"].iloc[:1], "pos": rows["block"].iloc[:1],
                             "total": -(-total // size), "digest": tree.root.decode()})

    rows = nodes.select("g", "pos", "total", F.col(digest).alias("digest"), _block_of().alias("block"))
    return stored(rows.groupBy("g", "block").applyInPandas(
        up, f"g {kind}, pos bigint, total bigint, digest string"))


def climbed(nodes: DataFrame, digest: str = "digest") -> list[DataFrame]:
    """The passes over ``nodes``: each holds the block roots of the one before, the last one node a group."""
    passes = []
    while (nodes.agg(F.max("total")).first()[0] or 1) > 1:
        nodes, digest = lifted(nodes, digest), "digest"
        passes.append(nodes)
    return passes


PATH = "lefts array<string>, rights array<string>, subroot string, root string"


def paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(g, pos, lefts, rights, subroot, root): the siblings of each node up to the root, from those of
    its block in ``above``."""
    block = Block
    kind = nodes.schema["g"].dataType.simpleString()

    def down(rows: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        rows, top = rows.sort_values("pos").reset_index(drop=True), upper.iloc[0]
        tree = block([x.encode() for x in rows["digest"]], int(rows["total"].iloc[0]))
        steps = [tree.path(i) for i in range(len(rows))]
        return pd.DataFrame({
            "g": rows["g"], "pos": rows["pos"],
            "lefts": [[x[1].decode() for x in s] + list(top["lefts"]) for s in steps],
            "rights": [[x[2].decode() for x in s] + list(top["rights"]) for s in steps],
            "subroot": top["subroot"], "root": top["root"]})

    rows = nodes.select("g", "pos", "total", "digest", _block_of().alias("block"))
    return stored(rows.groupBy("g", "block").cogroup(above.groupBy("g", "pos"))
                  .applyInPandas(down, f"g {kind}, pos bigint, {PATH}"))


def proven(rows: DataFrame, above: DataFrame) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded) of the leaves: ``proof`` joins the siblings level by level
    up to the root; ``folded`` is the root folded from the replaced leaf, if there is one, else the leaf."""
    block, folded = Block, fold
    kind = rows.schema["id"].dataType.simpleString()

    def down(rows: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        rows, top = rows.sort_values("pos").reset_index(drop=True), upper.iloc[0]
        tree = block([x.encode() for x in rows["leaf"]], int(rows["total"].iloc[0]))
        shared = [(hashlib.sha256(a.encode()), a.encode(), b.encode())
                  for a, b in zip(top["lefts"], top["rights"])]
        last = b"".join(a + b for _, a, b in shared)
        proofs, found, known = [], [], {}
        for i, (first, other) in enumerate(zip(rows["leaf"], rows["other"])):
            steps = tree.path(i)
            proofs.append((b"".join(a + b for _, a, b in steps) + last).decode())
            at = folded((first if pd.isna(other) else other).encode(), steps)
            if at not in known:             # the way from the block's root on is the same for equal roots
                known[at] = folded(at, shared).decode()
            found.append(known[at])
        return pd.DataFrame({"id": rows["id"], "leaf": rows["leaf"], "subroot": top["subroot"],
                             "root": top["root"], "proof": proofs, "folded": found})

    keyed = rows.select("id", "g", "pos", "total", "leaf", "other", _block_of().alias("block"))
    return keyed.groupBy("g", "block").cogroup(above.groupBy("g", "pos")).applyInPandas(
        down, f"id {kind}, leaf string, subroot string, root string, proof string, folded string")


def manifest(found: DataFrame) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded) of ``leaves``."""
    rows = stored(placed(stored(found), "g", ["id", "leaf"]))
    ends = rows.select("g", "pos", "total", F.col("leaf").alias("digest"))
    passes = [ends, *climbed(ends)]
    tops = passes.pop() if len(passes) > 1 else ends
    # The groups' roots are the leaves of the upper tree.
    top = stored(placed(tops.select(F.lit(0).alias("g"), F.col("g").alias("member"), "digest"), "g", ["member"]))
    above = climbed(top)
    first = (above.pop() if above else top).select(
        "g", "pos", F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"),
        F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for level in [*reversed(above), top]:
        first = paths(level, first)
    route = (first.drop("g", "subroot").join(top.select("pos", "member", F.col("digest").alias("subroot")), "pos")
             .select(F.col("member").alias("g"), F.lit(0).cast("bigint").alias("pos"), "lefts", "rights", "subroot", "root"))
    for level in reversed(passes[1:]):
        route = paths(level, route)
    return proven(rows, route)


def digests(proofs: DataFrame) -> DataFrame:
    return proofs.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
