"""A Merkle tree over the rows of a dataset, with a proof for every row."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import stored
from rolefit.llm.ranks import ranked
from rolefit.plans.joins import sized_join

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Levels of the tree in one block: a block has 2 ** BLOCK_LEVELS nodes at most.
BLOCK_LEVELS = 10
STEP = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    """A value as it is hashed: its length in UTF-8 bytes, a colon and its text, or ``-`` for null."""
    written = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(written).cast("string"), F.lit(":"), written), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def path_digest(path: Column) -> Column:
    """Hash of all siblings of a path, level by level and left to right."""
    parts = F.transform(path, lambda step: F.concat(step["left"], step["right"]))
    return F.sha2(F.array_join(parts, ""), 256)


@dataclass(frozen=True)
class Manifest:
    """The trees of a dataset.

    ``rounds`` are the blocks of nested nodes from the leaves up, ``tops`` those over the groups;
    ``roots`` has ``_group, subroot``, ``root`` one row with the root of all.
    """

    rounds: list[DataFrame]
    tops: list[DataFrame]
    roots: DataFrame
    root: DataFrame


def _levels(total: Column) -> Column:
    """How often ``total`` nodes are halved, rounding up, until one is left."""
    return F.when(total <= 1, 0).otherwise(F.length(F.bin(total - 1)))


def rollup(nodes: DataFrame, block_levels: int) -> DataFrame:
    """``_group, _levels, _block, _tree``: nodes of each block nested in their parents, up to one.

    ``nodes`` has ``_group, _rank, _levels, _node`` with ``_node.hash``. The low binary digits of the rank
    are columns; grouping by all but the last of them nests the two children of every parent, and so
    on until no digit is left. Blocks are shuffled once, every grouping reuses that. Above the
    ``_levels`` levels of a group one node is left, which passes unchanged.
    """
    digits = [f"_d{i}" for i in range(block_levels)]
    frame = nodes.withColumn("_block", F.shiftright("_rank", block_levels))
    frame = frame.withColumns(
        {d: F.shiftright("_rank", i).bitwiseAND(F.lit(1)).cast("tinyint") for i, d in enumerate(digits)}
    )
    frame = frame.drop("_rank").repartition("_group", "_block")
    frame = frame.sortWithinPartitions("_group", "_block", "_levels", *reversed(digits))
    for level, digit in enumerate(digits):
        child = lambda side, d=digit: F.max(F.when(F.col(d) == side, F.col("_node")))
        frame = frame.groupBy("_group", "_block", "_levels", *reversed(digits[level + 1 :])).agg(
            F.array_compact(F.array(child(0), child(1))).alias("_kids")
        )
        hashes = F.array_join(F.col("_kids.hash"), "")
        parent = F.when(F.col("_levels") > level, F.sha2(hashes, 256)).otherwise(hashes)
        frame = frame.withColumn("_node", F.struct(parent.alias("hash"), F.col("_kids").alias("kids"))).drop("_kids")
    return frame.withColumnRenamed("_node", "_tree")


def _children(hashed: Column) -> Callable[[Column], Column]:
    """From a node with its path to its children with theirs; only a ``hashed`` level adds a step."""

    def children(parent: Column) -> Column:
        kids = parent["node"]["kids"]

        def placed(kid: Column, i: Column) -> Column:
            left = F.when(i == 1, kids[0]["hash"]).otherwise("")
            right = F.when((i == 0) & (F.size(kids) > 1), F.get(kids, F.lit(1))["hash"]).otherwise("")
            step = F.array(F.struct(left.alias("left"), right.alias("right")))
            step = F.when(hashed, step).otherwise(F.array().cast(STEP))
            return F.struct(kid.alias("node"), F.concat(step, parent["path"]).alias("path"))

        return F.transform(kids, placed)

    return children


def unrolled(blocks: DataFrame, block_levels: int) -> DataFrame:
    """``_group, hash, item, path`` of every lowest node of ``blocks``, whose roots have the path ``_up``.

    Every level is a transform over the nodes of the block, which hands each child its parent's path
    behind its own sibling; one explode gives the rows.
    """
    found = F.array(F.struct(F.col("_tree").alias("node"), F.col("_up").alias("path")))
    for level in reversed(range(block_levels)):
        found = F.flatten(F.transform(found, _children(F.col("_levels") > level)))
    rows = blocks.select("_group", F.explode(found).alias("_found"))
    return rows.select("_group", "_found.node.hash", "_found.node.item", "_found.path")


def _built(nodes: DataFrame, block_levels: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of blocks over ``nodes(_group, _rank, _total, _node)``, and ``_group, hash`` of what remains."""
    nodes = nodes.withColumn("_levels", _levels(F.col("_total"))).drop("_total")
    rounds = []
    while True:
        blocks = stored(rollup(nodes, block_levels), label)
        rounds.append(blocks)
        left = F.greatest(F.col("_levels") - block_levels, F.lit(0))
        if blocks.filter("_block > 0").isEmpty():
            return rounds, blocks.select("_group", F.col("_tree.hash").alias("hash"))
        nodes = blocks.select(
            "_group",
            F.col("_block").alias("_rank"),
            left.alias("_levels"),
            F.struct(F.col("_tree.hash").alias("hash"), F.col("_block").alias("item")).alias("_node"),
        )


def build_manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    group: str = "lang",
    id_column: str = "doc_id",
    carried: dict[str, Column] | None = None,
    block_levels: int = BLOCK_LEVELS,
) -> Manifest:
    """Hash every row of ``docs`` and build the trees: one per group, and one over the groups.

    The leaf of a row is the SHA-256 of its ``fields``. Leaves of a group ascend by id, then by leaf;
    every two consecutive nodes have their hash as parent, the last one alone if it has no partner.
    A group without partners is its leaf. Groups ascend bytewise, null first, and are joined alike.

    Texts are read once; ranks, blocks and trees hold hashes only. Null is a group and an id like
    others (ids: first), equal rows are separate leaves side by side, an empty table has no root.
    ``carried`` are further expressions over a row that its leaf keeps. Other columns are not hashed.
    """
    carried = carried or {}
    leaves = docs.select(
        F.concat(F.lit("g"), F.col(group)).alias("_key"),
        F.col(id_column).alias("_id"),
        leaf_hash([F.col(c) for c in fields]).alias("_leaf"),
        F.struct(F.col(group).alias("group"), F.col(id_column).alias("id"), *(c.alias(n) for n, c in carried.items())).alias("_item"),
    )
    leaves = leaves.withColumn("_group", F.coalesce("_key", F.lit(""))).drop("_key")
    ordered = ranked(stored(leaves, "leaves"), "_group", ["_id", "_leaf"])
    nodes = ordered.select(
        "_group", "_rank", "_total", F.struct(F.col("_leaf").alias("hash"), F.col("_item").alias("item")).alias("_node")
    )
    rounds, roots = _built(nodes, block_levels, "tree")
    roots = stored(roots.select("_group", F.col("hash").alias("subroot")), "subroots")
    above = roots.select(F.lit("").alias("_all"), F.col("_group").alias("_of"), "subroot")
    above = ranked(above, "_all", ["_of"]).select(
        F.col("_all").alias("_group"),
        "_rank",
        "_total",
        F.struct(F.col("subroot").alias("hash"), F.col("_of").alias("item")).alias("_node"),
    )
    tops, root = _built(above, block_levels, "top")
    return Manifest(rounds, tops, roots, root.select(F.col("hash").alias("root")))


def proofs(manifest: Manifest, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """``leaf, path, subroot, root`` of every row, and what its leaf carries as ``group, id, …``.

    Inside a block no join is made. What lies above a block, one row per block, meets the block's
    single row of nested nodes.
    """
    none = F.array().cast(STEP)

    def down(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
        """The lowest nodes of ``rounds``; ``above`` has ``_group, _up`` of every tree."""
        over = above.withColumn("_block", F.lit(0).cast("bigint"))
        for blocks in reversed(rounds):
            found = unrolled(sized_join(blocks, over, ["_group", "_block"]), block_levels)
            if blocks is not rounds[0]:
                over = found.select("_group", F.col("item").alias("_block"), F.col("path").alias("_up"))
                over = stored(over, "paths")
        return found

    top = manifest.tops[0].sparkSession.range(1).select(F.lit("").alias("_group"), none.alias("_up"))
    over = stored(down(manifest.tops, top).select(F.col("item").alias("_group"), F.col("path").alias("_up")), "paths")
    rows = down(manifest.rounds, over).select("_group", F.col("hash").alias("leaf"), "item.*", "path")
    # One row per group, and one row.
    return sized_join(rows, manifest.roots, ["_group"]).join(F.broadcast(manifest.root)).drop("_group")


def manifest_proofs(
    docs: DataFrame,
    altered: dict[str, Column],
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """Every row's proof, checked against the row with the ``altered`` fields.

    Returns ``doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified``: the first ones from
    ``docs`` as it is, the last two from its rows after the change.
    """
    changed = leaf_hash([altered.get(c, F.col(c)) for c in FIELDS])
    manifest = build_manifest(docs, carried={"altered": changed}, block_levels=block_levels)
    found = proofs(manifest, block_levels).withColumn("folded_root", folded(F.col("altered"), F.col("path")))
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("group").alias("lang"),
        "leaf",
        "subroot",
        "root",
        path_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def altered_counts(every: int = 7) -> dict[str, Column]:
    """``n_chars`` one higher where ``every`` divides the CRC-32 of the id's decimal form."""
    chosen = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % every == 0
    return {"n_chars": F.when(chosen, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
