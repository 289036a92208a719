"""A Merkle tree over a dataset whose parents keep the hash states before each child.

Leaves are ranked inside their group and cut into blocks of whole subtrees, each
built in one task. Every parent keeps a copy of its hash state before each child
slot, so that folding a changed child resumes that state and reads nothing to its
left: only the replacement and the siblings to its right. What lies above a block
is one short path, computed for all children of a block of blocks at once, up to
the roots of the groups and the root of all. No task holds more than a block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparsight.llm import midstates as sha
from sparsight.operators.joins import lookup_join
from sparsight.operators.ordering import rank_rows
from sparsight.session import materialize

BLOCK = 4096
_STEP = "struct<state:binary,left:binary,right:binary>"
#: a path has a step per level, of a state and its siblings
_PATH_BYTES = 8192


@dataclass(frozen=True)
class Manifest:
    """``leaves``: the rows given, with ``b``, ``i`` (block, place in the group). ``blocks``: ``g, b, digests, states`` by
    level. ``paths``: ``g, b, path, subroot, root``, the steps above a block."""

    leaves: DataFrame
    blocks: DataFrame
    paths: DataFrame
    arity: int
    size: int

    def write(self, path: str) -> None:
        for name in ("leaves", "blocks", "paths"):
            table = getattr(self, name).withColumn("arity", F.lit(self.arity)).withColumn("size", F.lit(self.size))
            table.write.parquet(f"{path}/{name}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Manifest:
        """A manifest written before; one without any leaf has no arity of its own."""
        leaves, blocks, paths = (spark.read.parquet(f"{path}/{name}") for name in ("leaves", "blocks", "paths"))
        arity, size = blocks.select("arity", "size").first() or (2, BLOCK)
        return Manifest(*(t.drop("arity", "size") for t in (leaves, blocks, paths)), arity, size)


def leaf(values: list[Column]) -> Column:
    """SHA-256 (32 bytes) of values, each as its length in bytes, a colon and its text, or ``-`` where it is null."""
    text = [v.cast("string") for v in values]
    sized = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.unhex(F.sha2(F.concat(*sized), 256))


def group_key(group: Column) -> Column:
    """A name of the group that sorts null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _height(n: int, arity: int) -> int:
    levels = 0
    while arity**levels < n:
        levels += 1
    return levels


def subtree(digests: np.ndarray, levels: int, arity: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The digests of each level from the leaves up, and the states of each level's parents before every slot, by slot."""
    nodes, states = [digests], []
    for _ in range(levels):
        below = nodes[-1]
        n = below.shape[1]
        parents = -(-n // arity)
        state, kept = sha.started(parents), []
        for slot in range(arity):
            kept.append(state.copy())
            here = np.arange(slot, n, arity)
            if len(here):
                state[:, here // arity] = sha.absorb(state[:, here // arity], sha.as_block(below[:, here]))
        children = np.minimum(arity, n - np.arange(parents) * arity)
        nodes.append(sha.finished(state, children))
        states.append(np.stack(kept))
    return nodes, states


def _levels(n: int, arity: int, size: int, step: int) -> int:
    """Levels that a group of ``n`` leaves has in a step of blocks of ``size`` blocks."""
    deep = _height(size, arity)
    return min(deep, max(0, _height(n, arity) - step * deep))


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return sha.unpacked(b"".join(column.to_pylist()))


def _blocks(leaves: DataFrame, arity: int, size: int) -> DataFrame:
    """``g, b, n, root, digests, states`` of every block of leaves."""

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        n = rows.column("n")[0].as_py()
        nodes, states = subtree(_digests(rows.column("leaf")), _levels(n, arity, size, 0), arity)
        level = [sha.packed(x) for x in nodes]
        return pa.table({
            "g": rows.column("g")[:1], "b": rows.column("b")[:1], "n": rows.column("n")[:1], "root": pa.array([level[-1]], pa.binary()),
            "digests": pa.array([level], pa.list_(pa.binary())),
            "states": pa.array([[b"".join(map(sha.packed, s)) for s in states]], pa.list_(pa.binary())),
        })

    kind = "g string, b bigint, n bigint, root binary, digests array<binary>, states array<binary>"
    return leaves.select("g", "b", "i", "n", "leaf").groupBy("g", "b").applyInArrow(build, kind)


def _steps_above(nodes: DataFrame, arity: int, size: int, step: int) -> DataFrame:
    """``g, c, b, n, path, root`` of every node ``c`` in a block ``b`` of nodes: the steps from it to the block's root."""

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("c")
        m = rows.num_rows
        nodes, states = subtree(_digests(rows.column("digest")), _levels(rows.column("n")[0].as_py(), arity, size, step), arity)
        level = [sha.pieces(sha.packed(x)) for x in nodes]
        state = [[sha.pieces(sha.packed(s)) for s in x] for x in states]
        paths = []
        for at in range(m):
            path = []
            for below, kept in zip(level, state):
                parent, slot = divmod(at, arity)
                family = below[parent * arity : parent * arity + arity]
                path.append({"state": kept[slot][parent], "left": b"".join(family[:slot]), "right": b"".join(family[slot + 1:])})
                at = parent
            paths.append(path)
        kind = pa.list_(pa.struct([("state", pa.binary()), ("left", pa.binary()), ("right", pa.binary())]))
        return pa.table({
            "g": rows.column("g"), "c": rows.column("c"), "b": rows.column("b"), "n": rows.column("n"),
            "path": pa.array(paths, kind), "root": pa.array([level[-1][0]] * m, pa.binary()),
        })

    rows = nodes.withColumn("b", F.floor(F.col("c") / size).cast("bigint"))
    kind = f"g string, c bigint, b bigint, n bigint, path array<{_STEP}>, root binary"
    return rows.groupBy("g", "b").applyInArrow(build, kind)


def _climbed(nodes: DataFrame, arity: int, size: int, first: int, steps: int) -> DataFrame:
    """``g, c, path, root``: all steps from each node to the root of its group."""
    parts = []
    for step in range(first, steps):
        part = materialize(_steps_above(nodes, arity, size, step), "paths")
        parts.append(part)
        nodes = part.where(F.col("c") % size == 0).select("g", F.col("b").alias("c"), "n", F.col("root").alias("digest"))
    out = nodes.select("g", "c", F.array().cast(f"array<{_STEP}>").alias("path"), F.col("digest").alias("root"))
    for part in reversed(parts):
        above = out.select("g", F.col("c").alias("b"), F.col("path").alias("above"), F.col("root").alias("top"))
        out = part.join(above, ["g", "b"]).select("g", "c", F.concat("path", "above").alias("path"), F.col("top").alias("root"))
    return out


def manifest(rows: DataFrame, order: list[Column], arity: int = 2, block: int = BLOCK) -> Manifest:
    """The tree over ``rows``, which have ``g`` (``group_key``) and ``leaf`` (binary) besides columns of their own.

    Leaves of a group stand in the given order, then by digest; a parent takes
    ``arity`` of them, the last of a level fewer. A lone leaf is its group's
    root. The roots of the groups, ordered by ``g``, are combined likewise.
    A task builds subtrees of up to ``block`` leaves.
    Rows may have null keys and repeat; an empty table has an empty tree.
    Columns named ``b``, ``i``, ``n`` or ``at`` are refused.
    """
    taken = {"b", "i", "n", "at"} & {c.lower() for c in rows.columns}
    if taken or arity < 2:
        raise ValueError(f"name these columns otherwise: {sorted(taken)}" if taken else "a parent has two slots at least")
    size = arity
    while size * arity <= block:
        size *= arity
    ranked = rank_rows(materialize(rows, "leaves"), [F.col("g"), *order, F.col("leaf")], "at")
    groups = ranked.groupBy("g").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    groups = materialize(rank_rows(groups, [F.col("g")], "place"), "groups")
    largest, many, wide = groups.agg(F.max("n"), F.count("*"), F.max(F.octet_length("g"))).first()
    placed = lookup_join(ranked, groups.select("g", "first", "n"), ["g"], 64 + (wide or 0))
    leaves = placed.withColumn("i", F.col("at") - F.col("first")).withColumn(
        "b", F.floor(F.col("i") / size).cast("bigint")
    ).drop("at", "first")
    blocks = materialize(_blocks(leaves, arity, size), "blocks")

    steps = lambda n: max(1, -(-_height(n or 0, arity) // _height(size, arity)))
    roots = blocks.select("g", F.col("b").alias("c"), "n", F.col("root").alias("digest"))
    inner = materialize(_climbed(roots, arity, size, 1, steps(largest)), "paths").withColumnRenamed("root", "subroot")
    tops = inner.where("c = 0").join(groups.select("g", "place"), "g").select(
        F.lit("").alias("g"), F.col("place").alias("c"), F.lit(many).cast("bigint").alias("n"), F.col("subroot").alias("digest")
    )
    outer = _climbed(tops, arity, size, 0, steps(many)).select(F.col("c").alias("place"), F.col("path").alias("above"), "root")
    above = materialize(groups.select("g", "place").join(outer, "place").drop("place"), "paths")
    paths = lookup_join(inner, above, ["g"], _PATH_BYTES + (wide or 0)).select(
        "g", F.col("c").alias("b"), F.concat("path", "above").alias("path"), "subroot", "root"
    )
    return Manifest(leaves.drop("n"), blocks.drop("n", "root"), materialize(paths, "paths"), arity, size)


def fold_block(
    digests: list[np.ndarray], states: list[np.ndarray], places: np.ndarray, new: np.ndarray, arity: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of a block's root after each of ``new`` alone stands at its place; states and lengths of the proofs so far."""
    proof, length = sha.started(len(places)), np.zeros(len(places), np.int64)
    for below, kept in zip(digests[:-1], states):
        n = below.shape[1]
        parent, slot = places // arity, places % arity
        state = np.stack([kept[slot, word, parent] for word in range(8)])
        state = sha.absorb(state, sha.as_block(new))
        for other in range(arity):
            beside = parent * arity + other
            right = np.flatnonzero((other > slot) & (beside < n))
            if len(right):
                state[:, right] = sha.absorb(state[:, right], sha.as_block(below[:, beside[right]]))
            sibling = np.flatnonzero((other != slot) & (beside < n))
            if len(sibling):
                proof[:, sibling] = sha.absorb(proof[:, sibling], sha.as_block(below[:, beside[sibling]]))
                length[sibling] += 1
        new = sha.finished(state, np.minimum(arity, n - parent * arity))
        places = parent
    return new, proof, length


def _fold_path(path: list[dict], new: np.ndarray, proof: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded roots and proofs, from the roots of one block up its path."""
    for step in path:
        left, right = sha.pieces(step["left"]), sha.pieces(step["right"])
        new = sha.absorb(sha.unpacked(step["state"]), sha.as_block(new))
        for digest in right:
            new = sha.absorb(new, sha.as_block(sha.unpacked(digest)))
        new = sha.finished(new, len(left) + 1 + len(right))
        for digest in left + right:
            proof = sha.absorb(proof, sha.as_block(sha.unpacked(digest)))
        length = length + len(left) + len(right)
    return new, sha.finished(proof, length)


def folded(tree: Manifest, changes: DataFrame, new: str = "new") -> DataFrame:
    """``changes`` with ``folded``, ``proof``, ``subroot`` and ``root``, all binary.

    ``changes`` has ``g, b, i`` of leaves of the tree and their replacement
    ``new``. ``folded`` is the root of the tree in which that leaf alone is
    replaced, computed from the states kept; ``proof`` is SHA-256 of the
    siblings on its way in hexadecimal, from the leaf up, left to right.
    """
    arity, size = tree.arity, tree.size

    def run(block: pa.Table, rows: pa.Table) -> pa.Table:
        n = rows.num_rows if block.num_rows else 0
        rows = rows.slice(0, n)
        out = [pa.array([], pa.binary())] * 4
        if n:
            kept = {c: block.column(c)[0].as_py() for c in block.column_names}
            digests = [sha.unpacked(x) for x in kept["digests"]]
            states = [sha.unpacked(x).reshape(8, arity, -1).swapaxes(0, 1) for x in kept["states"]]
            places = rows.column("i").to_numpy() % size
            found = fold_block(digests, states, places, _digests(rows.column(new)), arity)
            top, proof = _fold_path(kept["path"] or [], *found)
            once = [pa.array([kept[c]] * n, pa.binary()) for c in ("subroot", "root")]
            out = [*(pa.array(sha.pieces(sha.packed(x)), pa.binary()) for x in (top, proof)), *once]
        for name, values in zip(("folded", "proof", "subroot", "root"), out):
            rows = rows.append_column(name, values)
        return rows

    kept = tree.blocks.join(tree.paths, ["g", "b"])
    kind = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in changes.schema)}, " + \
        "folded binary, proof binary, subroot binary, root binary"
    return kept.groupBy("g", "b").cogroup(changes.groupBy("g", "b")).applyInArrow(run, kind)
