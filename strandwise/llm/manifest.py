"""Merkle manifest of a table by time-forward processing.

Each row is a leaf: the SHA-256 of its columns. The leaves of a group, in key
order, form a binary tree; the groups' roots, in group order, form another one
with the manifest's root. Nodes are labelled level by level, so a child comes
before its parent. Forward sweep: nodes are taken by ascending label, and each
one sends its digest, through a priority queue ordered by label, to its parent.
Reversed sweep: nodes are taken by descending label, and each one sends the
proof from itself to the root (a suffix of its descendants' proofs) to its
children, until the leaves hold whole proofs.

The queue is external in two steps. Inside a block of 2**BLOCK_BITS positions of
a tree it is a heap, bounded by the block. Between blocks a message is a row
keyed by tree and block: Spark's shuffle sorts, spills and delivers it, and a
lost executor's part is made again from written tables. A sweep over n leaves
takes log(n) / BLOCK_BITS rounds, the largest tree is dealt out like all others,
and only counts reach the driver.

Nulls: a null column has its own code, a null key comes first in its group, null
is a group of its own and the first one. Equal keys are ordered by their digest;
fully equal rows are leaves of their own, in any order, as they are alike. An
empty table gives an empty result. Texts are hashed by Spark as they are read,
whatever their length, and never shuffled. Only the key and the stated columns
of the input are used, so further columns can't clash.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import cut_lineage
from strandwise.plans.lineage import broadcast_if_small, dense_index

#: A block holds 2**BLOCK_BITS neighbouring nodes of one level, and its heap as many messages.
BLOCK_BITS = 10
STEP = pa.struct([("left", pa.bool_()), ("digest", pa.string())])
PROOF = "ARRAY<STRUCT<left: BOOLEAN, digest: STRING>>"


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of the values' codes: `-` for null, else byte count, `:` and the value as text."""
    def code(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[code(v) for v in values]), 256)


def _levels(n: int) -> int:
    """Levels above n leaves until one node is left."""
    return max(n - 1, 0).bit_length()


def sweep_forward(digests: Sequence[str], levels: int, bits: int = BLOCK_BITS) -> dict[int, tuple[str, list[tuple[int, str]]]]:
    """Digest and children (place, digest) of every inner node of a block, by label.

    A label is `(level << bits) + place`. A last node without a neighbour is hashed alone.
    """
    nodes: dict[int, tuple[str, list[tuple[int, str]]]] = {}
    # Already ordered, hence a heap.
    queue = [((1 << bits) + (i >> 1), i, d) for i, d in enumerate(digests)] if levels else []
    while queue:
        label, children = queue[0][0], []
        while queue and queue[0][0] == label:
            children.append(heappop(queue)[1:])
        digest = sha256("".join(d for _, d in children).encode()).hexdigest()
        nodes[label] = digest, children
        level, place = divmod(label, 1 << bits)
        if level < levels:
            heappush(queue, (((level + 1) << bits) + (place >> 1), place, digest))
    return nodes


def sweep_back(nodes: dict, levels: int, suffix: tuple | None, bits: int = BLOCK_BITS) -> dict[int, tuple | None]:
    """Proof of each leaf of a block, as a chain `(left, digest, rest)`, from the proof of its top."""
    proofs: dict[int, tuple | None] = {}
    queue: list[tuple[int, tuple | None]] = [(-(levels << bits), suffix)]
    while queue:
        label, rest = heappop(queue)
        level, place = divmod(-label, 1 << bits)
        if not level:
            proofs[place] = rest
            continue
        children = nodes[-label][1]
        for i, (at, _) in enumerate(children):
            other = children[1 - i][1] if len(children) == 2 else None
            heappush(queue, (-(((level - 1) << bits) + at), (i == 1, other, rest)))
    return proofs


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("_pos")


def _block_levels(n: int, rounds: int, bits: int) -> int:
    return min(max(_levels(n) - rounds * bits, 0), bits)


def _forward(nodes: DataFrame, rounds: int, bits: int) -> DataFrame:
    """The top of each block, as the next round's nodes."""
    def tops(key: tuple, table: pa.Table) -> pa.Table:
        table = _in_order(table)
        digests, n = table["_digest"].to_pylist(), table["_n"][0].as_py()
        levels = _block_levels(n, rounds, bits)
        top = sweep_forward(digests, levels, bits)[levels << bits][0] if levels else digests[0]
        # Python's scalars of the key; a tree whose top is known goes on as its only node.
        row = {"_tree": key[0], "_n": n, "_pos": key[1], "_digest": top}
        return pa.table({k: pa.array([v.as_py() if isinstance(v, pa.Scalar) else v]) for k, v in row.items()})

    block = F.shiftright("_pos", bits).alias("_block")
    return nodes.select("_tree", "_n", "_pos", "_digest").groupBy("_tree", block).applyInArrow(
        tops, "_tree BIGINT, _n BIGINT, _pos BIGINT, _digest STRING"
    )


def _chains(suffix: list[dict]) -> tuple | None:
    chain = None
    for step in reversed(suffix):
        chain = (step["left"], step["digest"], chain)
    return chain


def _proof_column(chains: list[tuple | None]) -> pa.Array:
    left, digests, offsets = [], [], [0]
    for chain in chains:
        while chain is not None:
            left.append(chain[0])
            digests.append(chain[1])
            chain = chain[2]
        offsets.append(len(left))
    steps = pa.StructArray.from_arrays([pa.array(left, pa.bool_()), pa.array(digests, pa.string())], fields=list(STEP))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps)


def _backward(nodes: DataFrame, above: DataFrame, rounds: int, bits: int) -> DataFrame:
    """`nodes` with `_proof`, given the proofs `_tree, _pos, _proof` of their blocks' tops."""
    def proofs(key: tuple, table: pa.Table, tops: pa.Table) -> pa.Table:
        table = _in_order(table)
        levels = _block_levels(table["_n"][0].as_py(), rounds, bits)
        nodes = sweep_forward(table["_digest"].to_pylist(), levels, bits)
        found = sweep_back(nodes, levels, _chains(tops["_proof"][0].as_py()), bits)
        column = _proof_column([found[i] for i in range(table.num_rows)])
        return table.append_column("_proof", column).select([f.name for f in schema.fields])

    block = F.shiftright("_pos", bits).alias("_block")
    schema = nodes.withColumn("_proof", F.lit(None).cast(PROOF)).schema
    return nodes.groupBy("_tree", block).cogroup(above.groupBy("_tree", "_pos")).applyInArrow(proofs, schema)


def _sweeps(nodes: DataFrame, bits: int) -> tuple[DataFrame, list[DataFrame]]:
    """The root of each tree, and the written nodes of every round below it."""
    most = nodes.agg(F.max("_n")).first()[0] or 0
    tables = [nodes]
    for rounds in range(max(1, -(-_levels(most) // bits))):
        tables.append(cut_lineage(_forward(tables[-1], rounds, bits)))
    return tables[-1], tables[:-1]


def _proved(tables: list[DataFrame], above: DataFrame, bits: int) -> DataFrame:
    for rounds, nodes in reversed(list(enumerate(tables))):
        above = _backward(nodes, above, rounds, bits)
    return above


def manifest(
    rows: DataFrame,
    columns: Sequence[str],
    key: str,
    group: str,
    claims: Mapping[str, Column] | None = None,
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """`key, leaf, claimed, subroot, root, proof` of each row.

    `columns` are hashed in the given order, trees are made per `group` by
    ascending `key`. `claims` replaces columns by other values: `claimed` is the
    digest that a row would have with these. `proof` lists, from leaf to root,
    the sibling at each level and whether it stands to the left; its digest is
    null where the node is hashed alone.
    """
    if key in ("leaf", "claimed", "subroot", "root", "proof"):
        raise ValueError(f"rename the key column {key}")
    claims = claims or {}
    # The tag keeps null apart and first, and the others in bytewise order.
    tag = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = rows.select(
        F.col(key).alias("_key"),
        tag.alias("_tag"),
        leaf_digest([F.col(c) for c in columns]).alias("_digest"),
        leaf_digest([claims.get(c, F.col(c)) for c in columns]).alias("_claimed"),
    )
    # Written, so that texts are hashed once; the last column splits equal rows over many ranges.
    leaves = cut_lineage(leaves.withColumn("_spread", F.monotonically_increasing_id()))
    ranked = dense_index(leaves, ["_tag", "_key", "_digest", "_spread"], "_idx").drop("_spread")
    groups = ranked.groupBy("_tag").agg(F.min("_idx").alias("_first"), F.count("*").alias("_n"))
    groups = cut_lineage(dense_index(groups, ["_tag"], "_tree"))
    nodes = cut_lineage(
        ranked.join(broadcast_if_small(groups), "_tag").withColumn("_pos", F.col("_idx") - F.col("_first"))
        .select("_key", "_digest", "_claimed", "_tree", "_n", "_pos")
    )
    subroots, tables = _sweeps(nodes, bits)
    total = groups.count()
    trees = subroots.select(
        F.lit(0).cast("bigint").alias("_tree"), F.lit(total).cast("bigint").alias("_n"),
        F.col("_tree").alias("_pos"), "_digest",
    )
    root, upper = _sweeps(trees, bits)
    # The whole dataset has one root: a single row.
    at_root = root.select("_tree", F.lit(0).cast("bigint").alias("_pos"), F.array().cast(PROOF).alias("_proof"))
    proved = _proved(upper, at_root, bits).select(
        F.col("_pos").alias("_tree"), F.lit(0).cast("bigint").alias("_pos"), "_proof"
    )
    names = subroots.select("_tree", F.col("_digest").alias("subroot"))
    found = _proved(tables, cut_lineage(proved), bits).join(broadcast_if_small(names), "_tree")
    top = root.select("_digest").limit(1).scalar()
    return found.select(
        F.col("_key").alias(key), F.col("_digest").alias("leaf"), F.col("_claimed").alias("claimed"),
        "subroot", top.alias("root"), F.col("_proof").alias("proof"),
    )


def proof_digest(proof: str | Column) -> Column:
    """SHA-256 of the siblings of a proof, from leaf to root."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["digest"]), ""), 256)


def folded(leaf: str | Column, proof: str | Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    def parent(digest: Column, step: Column) -> Column:
        other = F.coalesce(step["digest"], F.lit(""))
        return F.sha2(F.when(step["left"], F.concat(other, digest)).otherwise(F.concat(digest, other)), 256)

    start = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(proof, start, parent)
