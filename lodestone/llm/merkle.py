"""A Merkle manifest of a dataset as a postorder append log.

Each group's rows, in order, are the leaves of a tree in which every ``FAN`` consecutive nodes
of a level become one node of the next (the last run may be shorter, down to one node, which
still becomes its own hash) until one is left. The groups' roots are the leaves of a tree of the
same kind, whose root stands for the dataset.

Builders are aligned: each takes the leaves of one whole subtree of ``FAN ** DEPTH`` leaves and
appends a node as soon as its last child is there, which is postorder. Where a node stands needs
no search: with ``P(x) = x + x/8 + x/64 + ...`` (whole parts) nodes before leaf ``x`` and
``S = m + ceil(m/8) + ...`` nodes over ``m`` leaves, node ``i`` of level ``l`` is at
``P(i * 8**l) + S - 1``. So the siblings of a leaf are read from the log by their positions.
Builders' roots are the leaves of the next layer of builders, so a tree of ``n`` leaves takes
``log(n)`` to the base 512 passes, each over a 512th of the one before. No task holds more than
one such subtree, and only the one root comes to the driver.

Defined cases: a null value is ``-``; a null group is the first one; null ids come first; rows
of one id are ordered by their hashes; a single row is its group's root, a single group's root
is the root, and a leaf without any siblings has an empty proof; an empty table has no root and
gives no rows; values may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.durable import durable
from lodestone.plans.keyed import MAX_BROADCAST_KEYS
from lodestone.plans.ordered import global_rank

#: Children of a node, and levels that one builder makes.
FAN, DEPTH = 8, 3
BLOCK = FAN**DEPTH


def leaf_digest(columns: Sequence[Column]) -> Column:
    """The hash of a row: every value with its length before it, so that no two rows read alike."""
    told = []
    for column in columns:
        value = column.cast("string")
        told.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*told), 256)


def node_hash(children: Sequence[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


# Positions. ------------------------------------------------------------------------------------


def before_leaf(leaf: int) -> int:
    """Nodes that are complete before leaf ``leaf`` arrives."""
    total = leaf
    while leaf:
        leaf //= FAN
        total += leaf
    return total


def subtree_size(leaves: int, level: int) -> int:
    """Nodes of a subtree of ``level`` levels over so many leaves."""
    return sum(-(-leaves // FAN**k) for k in range(level + 1))


def position(level: int, index: int, leaves: int) -> int:
    """Where the log of a tree of ``leaves`` has node ``index`` of ``level``."""
    first = index * FAN**level
    return before_leaf(first) + subtree_size(min(FAN**level, leaves - first), level) - 1


def _position(level: Column, index: Column, leaves: Column) -> Column:
    """``position`` as a column."""
    power = lambda k: F.pow(F.lit(FAN), k).cast("long")
    first = (index * power(level)).cast("long")
    digits = F.sequence(F.lit(0), F.lit(20))
    parts = lambda x, top: F.aggregate(digits, F.lit(0).cast("long"), lambda s, k: s + F.when(k <= top, x(k)).otherwise(0))
    width = F.least(power(level), leaves - first)
    done = parts(lambda k: F.floor(first / power(k)).cast("long"), F.lit(20))
    own = parts(lambda k: F.ceil(width / power(k)).cast("long"), level)
    return done + own - 1


def _height(leaves: Column) -> Column:
    """Levels above the leaves: the octal digits of ``leaves - 1``."""
    return F.when(leaves <= 1, 0).otherwise(F.length(F.conv((leaves - 1).cast("string"), 10, FAN)))


# Builders. -------------------------------------------------------------------------------------


def append_nodes(leaves: Sequence[str], levels: int) -> list[str]:
    """The log of one subtree: every node as soon as it is complete."""
    log: list[str] = []
    open_: list[list[str]] = [[] for _ in range(levels + 1)]

    def close(level: int) -> None:
        children, open_[level] = open_[level], []
        append(level + 1, node_hash(children))

    def append(level: int, digest: str) -> None:
        log.append(digest)
        open_[level].append(digest)
        if level < levels and len(open_[level]) == FAN:
            close(level)

    for digest in leaves:
        append(0, digest)
    for level in range(levels):
        if open_[level]:
            close(level)
    return log


def siblings(log: Sequence[str], leaf: int, leaves: int, levels: int) -> list[tuple[int, list[str]]]:
    """For each level, how many siblings stand before the leaf's own node, and all of them, from the log's positions."""
    found = []
    for level in range(levels):
        own = leaf // FAN**level
        count = -(-leaves // FAN**level)
        run = range(own - own % FAN, min(own - own % FAN + FAN, count))
        found.append((own % FAN, [log[position(level, i, leaves)] for i in run if i != own]))
    return found


def fold(leaf: str, path: Sequence[tuple[int, Sequence[str]]]) -> str:
    """The root that ``leaf`` has with these siblings."""
    for place, others in path:
        leaf = node_hash([*others[:place], leaf, *others[place:]])
    return leaf


_WIDTH = 32
_SEGMENT = "tree long, block long, height int, leaves int, levels int, nodes binary, top binary"
_PATH = "array<struct<place: int, siblings: binary>>"


def _hexes(packed: bytes) -> list[str]:
    digits = packed.hex()
    return [digits[i : i + 2 * _WIDTH] for i in range(0, len(digits), 2 * _WIDTH)]


def _builder(layer: int):
    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        tree, block, height = (rows.column(c)[0].as_py() for c in ("tree", "block", "height"))
        levels = max(0, min(DEPTH, height - DEPTH * layer))
        log = append_nodes([d.hex() for d in rows.column("digest").to_pylist()], levels)
        packed = bytes.fromhex("".join(log))
        row = {"tree": tree, "block": block, "height": height, "leaves": rows.num_rows, "levels": levels, "nodes": packed, "top": packed[-_WIDTH:]}
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table({k: pa.array([v], t) for (k, v), t in zip(row.items(), types)})

    return build


def _layers(leaves: DataFrame, tallest: int, label: str) -> list[DataFrame]:
    """The segments that builders append, layer by layer, from ``tree, at, height, digest``."""
    segments, items = [], leaves
    for layer in range(max(1, -(-tallest // DEPTH))):
        blocks = items.withColumn("block", F.floor(F.col("at") / BLOCK).cast("long"))
        made = blocks.groupBy("tree", "block").applyInArrow(_builder(layer), _SEGMENT)
        segments.append(durable(made, f"{label}{layer}"))
        items = segments[-1].where(F.col("height") > DEPTH * (layer + 1)).select("tree", F.col("block").alias("at"), "height", F.col("top").alias("digest"))
    return segments


def _last(segments: Sequence[DataFrame]) -> DataFrame:
    """``tree, subroot``: the root of each tree, from the layer in which it ends."""
    ends = [s.where(F.col("height") <= DEPTH * (k + 1)).select("tree", F.col("top").alias("subroot")) for k, s in enumerate(segments)]
    out = ends[0]
    for more in ends[1:]:
        out = out.unionByName(more)
    return out


@dataclass
class Manifest:
    """``leaves`` (tree, at, height, id, leaf, claim), ``trees`` (tree, group, n, height), the log's segments, and the root."""

    leaves: DataFrame
    trees: DataFrame
    segments: list[DataFrame]
    forest: list[DataFrame]
    root: str | None


def _by_tree(rows: DataFrame, trees: DataFrame, on: Column) -> DataFrame:
    """One row per group is broadcast where there are few groups."""
    return rows.join(F.broadcast(trees) if trees.count() <= MAX_BROADCAST_KEYS else trees, on)


def build(docs: DataFrame, columns: Sequence[str], group_col: str, id_col: str, claim: Column | None = None) -> Manifest:
    """The manifest of ``docs``: a tree for each value of ``group_col`` over its rows by ``id_col``.

    ``claim``: a digest that each row claims to have, to be checked with ``verify``; its own if
    none is given. Texts are hashed where they are; only digests move.
    """
    leaf = leaf_digest([F.col(c) for c in columns])
    rows = docs.select(
        F.col(group_col).alias("group"), F.col(id_col).alias("id"), F.unhex(leaf).alias("leaf"), F.unhex(leaf if claim is None else claim).alias("claim")
    )
    ranked = global_rank(rows, [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf")], "rank")
    groups = durable(ranked.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("start")), "groups")
    trees = durable(global_rank(groups, [F.col("start")], "tree").select("tree", "group", "n", "start", _height(F.col("n")).alias("height")), "trees")
    starts = trees.select("tree", "start", "height", F.col("group").alias("g"))
    leaves = _by_tree(ranked, starts, F.col("group").eqNullSafe(F.col("g"))).select("tree", (F.col("rank") - F.col("start")).alias("at"), "height", "id", "leaf", "claim")
    tallest = trees.agg(F.max("height"), F.count(F.lit(1))).first()
    segments = _layers(leaves.select("tree", "at", "height", F.col("leaf").alias("digest")), tallest[0] or 0, "segments")
    height = trees.select(_height(F.lit(tallest[1])).alias("h")).first()
    height = height["h"] if height else 0
    roots = _last(segments).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(height).alias("height"), F.col("subroot").alias("digest"))
    forest = _layers(roots, height, "forest")
    last = forest[-1].where(F.col("height") <= DEPTH * len(forest)).select(F.hex("top").alias("root")).first()
    return Manifest(leaves, trees.drop("start"), segments, forest, last["root"].lower() if last else None)


def log(manifest: Manifest) -> DataFrame:
    """``tree, position, level, index, digest``: every node of the groups' trees at its place in the tree's log."""
    out = None
    sizes = manifest.trees.select("tree", "n")
    for layer, segment in enumerate(manifest.segments):
        nodes = F.expr(f"transform(sequence(0, cast(length(nodes) / {_WIDTH} as int) - 1), i -> substring(nodes, i * {_WIDTH} + 1, {_WIDTH}))")
        each = segment.select("tree", "block", "leaves", "levels", F.explode(F.sequence(F.lit(0), F.col("levels"))).alias("l"), nodes.alias("nodes"))
        count = F.ceil(F.col("leaves") / F.pow(F.lit(FAN), F.col("l"))).cast("int")
        each = each.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("i")).where(F.col("l") > 0 if layer else F.lit(True))
        here = F.element_at("nodes", (_position(F.col("l"), F.col("i"), F.col("leaves")) + 1).cast("int"))
        level = F.col("l") + DEPTH * layer
        index = (F.col("block") * F.pow(F.lit(FAN), DEPTH - F.col("l")).cast("long") + F.col("i")).cast("long")
        part = _by_tree(each.select("tree", level.alias("level"), index.alias("index"), here.alias("digest")), sizes.withColumnRenamed("tree", "t"), F.col("tree") == F.col("t"))
        part = part.select("tree", _position(F.col("level"), F.col("index"), F.col("n")).alias("position"), "level", "index", F.lower(F.hex("digest")).alias("digest"))
        out = part if out is None else out.unionByName(part)
    return out


# Proofs. ---------------------------------------------------------------------------------------


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From segments with the path above them, the path of each of their leaves."""
    kind = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.binary())]))
    for batch in batches:
        trees, places, paths = [], [], []
        for row in batch.to_pylist():
            nodes = _hexes(row["nodes"])
            for leaf in range(row["leaves"]):
                own = [{"place": p, "siblings": bytes.fromhex("".join(s))} for p, s in siblings(nodes, leaf, row["leaves"], row["levels"])]
                trees.append(row["tree"])
                places.append(row["block"] * BLOCK + leaf)
                paths.append(own + row["path"])
        yield pa.RecordBatch.from_arrays([pa.array(trees, pa.int64()), pa.array(places, pa.int64()), pa.array(paths, kind)], ["tree", "at", "path"])


def _above(segments: Sequence[DataFrame], ends: DataFrame) -> DataFrame:
    """The first layer's segments, each with the ``path`` from its root to the top.

    ``ends`` has ``tree, path`` for the trees' roots. The path of a segment is made from the
    segment of the next layer that has its root as a leaf.
    """
    below = None
    for layer in range(len(segments) - 1, -1, -1):
        segment = segments[layer]
        closing = segment.where(F.col("height") <= DEPTH * (layer + 1)).join(ends.withColumnRenamed("tree", "t"), F.col("tree") == F.col("t")).drop("t")
        if below is None:
            known = closing
        else:
            led = below.select(F.col("tree").alias("t"), F.col("at").alias("b"), "path")
            going = segment.where(F.col("height") > DEPTH * (layer + 1)).join(led, (F.col("tree") == F.col("t")) & (F.col("block") == F.col("b"))).drop("t", "b")
            known = closing.unionByName(going)
        if layer:
            below = durable(known.mapInArrow(_paths, f"tree long, at long, path {_PATH}"), "paths")
    return known


def _check(root: str, id_type: pa.DataType):
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def check(rows: pa.Table, segment: pa.Table) -> pa.Table:
        known = segment.to_pylist()[0]
        nodes, above = _hexes(known["nodes"]), [(p["place"], _hexes(p["siblings"])) for p in known["path"]]
        columns: list[list] = [[] for _ in names[1:]]
        for at, leaf, claim in zip(*(rows.column(c).to_pylist() for c in ("at", "leaf", "claim"))):
            path = siblings(nodes, at % BLOCK, known["leaves"], known["levels"]) + above
            folded = fold(claim.hex(), path)
            proof = node_hash([s for _, others in path for s in others])
            for column, x in zip(columns, (leaf.hex(), known["subroot"].hex(), root, proof, folded, folded == root)):
                column.append(x)
        types = [pa.string()] * 5 + [pa.bool_()]
        return pa.Table.from_arrays([rows.column("id").cast(id_type), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    return check


def verify(manifest: Manifest) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root, verified`` per row: each claim folded with its leaf's siblings.

    A group is one builder's block, 512 rows at most, with its segment of the log.
    """
    spark = manifest.leaves.sparkSession
    forest = _above(manifest.forest, spark.createDataFrame([(0, [])], f"tree long, path {_PATH}"))
    ends = durable(forest.mapInArrow(_paths, f"tree long, at long, path {_PATH}").select(F.col("at").alias("tree"), "path"), "ends")
    roots = _last(manifest.segments).withColumnRenamed("tree", "r")
    segments = _above(manifest.segments, ends)
    segments = segments.join(roots, F.col("tree") == F.col("r")).select("tree", "block", "leaves", "levels", "nodes", "path", "subroot")
    rows = manifest.leaves.select("tree", F.floor(F.col("at") / BLOCK).cast("long").alias("block"), "at", "id", "leaf", "claim")
    kind = manifest.leaves.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    check = _check(manifest.root or "", to_arrow_type(kind))
    schema = f"id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return rows.groupBy("tree", "block").cogroup(segments.groupBy("tree", "block")).applyInArrow(check, schema)


def lower_ascii(text: Column) -> Column:
    """A change to a text that a manifest must notice, unless it changes nothing."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
