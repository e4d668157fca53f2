"""A Merkle manifest of a table: digests of rows, a tree for each group of rows, and one root over the groups.

Digests are hexadecimal text, so a digest is exactly one block of SHA-256. A
parent is the hash of its children's digests in order and retains a copy of the
hash state before each child slot: to fold a replaced child into its parent, the
state of its slot is resumed with the replacement and the siblings to its right;
what is to the left is never hashed again.

A tree is cut into chunks of ``RUN ** CHUNK_LEVELS`` leaves, each built in one
task; the tops of a tree's chunks are the leaves of the next pass, until each
group has one node, and the groups' nodes are the leaves of one more tree. Going
down again, a chunk gets the path that all its leaves share (the runs above it,
each with the slot that leads down), and folds every leaf through its own levels
and that path. So every pass moves digests only, no task holds more than a
chunk, and a table of n rows takes log(n) / log(chunk) passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathsieve.llm.common import durable, forget, ranked, table

#: Children of a parent.
RUN = 8
#: Levels that one task builds; a chunk has RUN ** CHUNK_LEVELS leaves.
CHUNK_LEVELS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of a digest.
WIDTH = 64


def leaf(*values: Column) -> Column:
    """Hash of values one after another: ``-`` for null, else the UTF-8 byte count, ``:`` and the value as text."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256)


class Parent:
    """A run of children; keeps the hash state before each of them."""

    def __init__(self, children: bytes):
        self.children, self.states, state = children, [], hashlib.sha256()
        for at in range(0, len(children), WIDTH):
            self.states.append(state.copy())
            state.update(children[at : at + WIDTH])
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, child: bytes) -> bytes:
        """The parent's digest with another child in a slot."""
        state = self.states[slot].copy()
        state.update(child)
        state.update(self.children[(slot + 1) * WIDTH :])
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> bytes:
        return self.children[: slot * WIDTH] + self.children[(slot + 1) * WIDTH :]


def levels_of(total: int, levels: int) -> int:
    """Levels of a chunk in a tree of ``total`` leaves: all that a chunk has, or as many as leave one node."""
    needed, n = 0, total
    while n > 1 and needed < levels:
        needed, n = needed + 1, -(-n // RUN)
    return needed


def build(leaves: list[bytes], levels: int) -> tuple[list[list[Parent]], bytes]:
    """The parents of each level, lowest first, and the top of a chunk."""
    tree, nodes = [], leaves
    for _ in range(levels):
        tree.append([Parent(b"".join(nodes[at : at + RUN])) for at in range(0, len(nodes), RUN)])
        nodes = [p.digest for p in tree[-1]]
    return tree, nodes[0]


def way_up(tree: list[list[Parent]], index: int) -> Iterator[tuple[Parent, int]]:
    for parents in tree:
        index, slot = divmod(index, RUN)
        yield parents[index], slot


def _chunk(levels: int) -> Column:
    return F.expr(f"`index` div {RUN**levels}")


def _sorted(group: pa.Table, column: str) -> tuple[list[bytes], pa.Table, int]:
    """Digests of a chunk in their order, its rows in that order, and its tree's leaves."""
    rows = group.sort_by("index")
    return [x.encode() for x in rows.column(column).to_pylist()], rows, rows.column("total")[0].as_py()


def _tops(nodes: DataFrame, levels: int) -> DataFrame:
    """(key, index, total, digest) of the chunks of ``nodes`` (key, index, total, digest)."""
    schema = nodes.select("key", "index", "total", "digest").schema

    def run(group: pa.Table) -> pa.Table:
        digests, rows, total = _sorted(group, "digest")
        top = build(digests, levels_of(total, levels))[1]
        return pa.table([rows.column("key")[:1].cast(pa.string()), [rows.column("index")[0].as_py() // RUN**levels], [-(-total // RUN**levels)], [top.decode()]], names=["key", "index", "total", "digest"])

    return nodes.groupBy("key", _chunk(levels).alias("chunk")).applyInArrow(run, schema)


def _path(steps: Iterator[tuple[Parent, int]]) -> list[dict]:
    return [{"run": p.children.decode(), "slot": slot} for p, slot in steps]


PATH = "array<struct<run: string, slot: int>>"
_ARROW_PATH = pa.list_(pa.struct([("run", pa.string()), ("slot", pa.int32())]))


def _paths(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """(key, chunk, path): for each of ``nodes``, which are chunks' tops, the runs from it to the root; ``above``: (key, chunk, path) of the chunks they are in."""

    def run(group: pa.Table, over: pa.Table) -> pa.Table:
        digests, rows, total = _sorted(group, "digest")
        rest = over.column("path")[0].as_py()
        tree, _ = build(digests, levels_of(total, levels))
        first = rows.column("index")[0].as_py()
        made = [_path(way_up(tree, i)) + rest for i in range(len(digests))]
        return pa.table([rows.column("key").cast(pa.string()), pa.array(range(first, first + len(digests)), pa.int64()), pa.array(made, _ARROW_PATH)], names=["key", "chunk", "path"])

    return nodes.groupBy("key", _chunk(levels).alias("chunk")).cogroup(above.groupBy("key", "chunk")).applyInArrow(run, f"key string, chunk long, path {PATH}")


def manifest(rows: DataFrame, key: str, order: str, leaf: str, changed: str | None = None, levels: int = CHUNK_LEVELS) -> DataFrame:
    """(order, leaf, subroot, root, proof, folded_root) of every row.

    ``leaf`` holds the rows' digests, ``changed`` those that take their places
    when a row is folded (the same ones by default). Leaves of a key ascend by
    ``order``, equal ones by digest; nulls come first, and a null key is a key.
    Runs of ``RUN`` nodes, the last perhaps shorter, become their hash until one
    remains: the key's subroot. Subroots in the order of their keys' bytes become
    the root in the same way. proof is the hash of all siblings, left to right,
    level by level from the leaf to the root; folded_root is what the changed
    leaf gives with these siblings. An empty table has no rows here.
    """
    if changed is None:
        changed = leaf
    given = rows.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{order}`").alias("at"), F.col(f"`{leaf}`").alias("digest"), F.col(f"`{changed}`").alias("changed"))
    # texts are hashed once; from here on only digests move
    given = durable(given)
    leaves = durable(ranked(given, ["key"], ["at", "digest", "changed"]))
    forget(given)
    passes = [leaves.select("key", "index", "total", "digest")]
    while passes[-1].where(F.col("total") > 1).limit(1).count():
        passes.append(durable(_tops(passes[-1], levels)))
    # the subroots are the leaves of one more tree
    roots = durable(ranked(passes[-1].select(F.lit("").alias("all"), F.col("key").alias("name"), "digest"), ["all"], ["name"]))
    over = [roots.select(F.col("all").alias("key"), "index", "total", "digest")]
    while over[-1].where(F.col("total") > 1).limit(1).count():
        over.append(durable(_tops(over[-1], levels)))
    top = over[-1].first()
    path = over[-1].select("key", F.col("index").alias("chunk"), F.array().cast(PATH).alias("path"))
    for nodes in reversed(over[:-1]):
        path = _paths(nodes, path, levels)
    # a subroot's path is that of the one chunk below it
    named = roots.select("index", F.col("name").alias("key"), F.col("digest").alias("subroot"))
    path = durable(path.join(named, F.col("chunk") == F.col("index")).select(named["key"], F.lit(0).cast("long").alias("chunk"), "path", "subroot"))
    own = path.select(F.col("key").alias("_key"), "subroot")
    path = path.select("key", "chunk", "path")
    for nodes in reversed(passes[1:-1]):
        path = durable(_paths(nodes, path, levels))
    upper = path.join(own, F.col("key").eqNullSafe(F.col("_key"))).select("key", "chunk", "path", "subroot", F.lit(top.digest if top else None).cast("string").alias("root"))
    kind = rows.schema[order].dataType
    schema = given.select("key", F.col("at").cast(kind), F.col("digest").alias("leaf")).schema.add("subroot", "string").add("root", "string").add("proof", "string").add("folded_root", "string")

    def run(group: pa.Table, over: pa.Table) -> pa.Table:
        digests, rows, total = _sorted(group, "digest")
        tree, _ = build(digests, levels_of(total, levels))
        shared = [(Parent(x["run"].encode()), x["slot"]) for x in over.column("path")[0].as_py()]
        beside = b"".join(p.siblings(slot) for p, slot in shared)
        proofs, folded = [], []
        for i, node in enumerate(rows.column("changed").to_pylist()):
            node, proof = node.encode(), hashlib.sha256()
            for parent, slot in way_up(tree, i):
                proof.update(parent.siblings(slot))
                node = parent.fold(slot, node)
            proof.update(beside)
            for parent, slot in shared:
                node = parent.fold(slot, node)
            proofs.append(proof.hexdigest())
            folded.append(node.decode())
        n = len(folded)
        same = [pa.array([over.column(c)[0].as_py()] * n, pa.string()) for c in ("subroot", "root")]
        return pa.table([rows.column("key").cast(pa.string()), rows.column("at"), rows.column("digest").cast(pa.string()), *same, pa.array(proofs), pa.array(folded)], names=["key", "at", "leaf", "subroot", "root", "proof", "folded_root"])

    made = leaves.groupBy("key", _chunk(levels).alias("chunk")).cogroup(upper.groupBy("key", "chunk")).applyInArrow(run, schema)
    return made


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in trees by lang; a third of them, by the checksum of doc_id, are folded with a text in lower case."""
    docs = table(spark, sf_dir, "documents")
    given = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    own = leaf(*given, F.col("text"))
    tampered = F.when(hit & F.col("text").rlike("[A-Z]"), leaf(*given, F.translate("text", UPPER, LOWER))).otherwise(F.col("leaf"))
    rows = docs.withColumn("leaf", own).withColumn("changed", tampered).select("doc_id", "lang", "leaf", "changed")
    made = manifest(rows, "lang", "doc_id", "leaf", "changed")
    return made.select(F.col("at").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
