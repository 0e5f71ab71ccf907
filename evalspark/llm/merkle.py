"""Merkle manifest of a data set, kept as postorder append logs.

Leaves are numbered per tree (say, per language). Aligned builders take ``2**BITS`` consecutive
leaves each and append nodes in the order in which they are completed, so a right child lies just
before its parent and the left sibling one subtree further back. The same builders then take the
tops of the blocks as their leaves, and so on until one node is left: tiers of logs, each
``2**BITS`` times shorter than the one below.

Where a node lies needs no search. In the log over n leaves a node whose last leaf is the e-th
(counted from one) follows all nodes that were complete by then, and the subtrees complete at e
hold 2e - (one bits of e) nodes. ``position`` states that in closed form; builders, proofs and
``log`` use it and nothing else.

A proof is read top down. A block's own path (from its top to the root of the manifest) is one
short row, joined to the block's log once, never once per leaf. No task holds more than a block;
a tree of any share of the rows has as many blocks as it needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import whole_groups
from evalspark.plans.durable import stored
from evalspark.plans.numbering import number_rows

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BITS = 10
LONE, LEFT, RIGHT = 0, 1, 2  # a sibling's side; LONE: the run has one node
PATH = "array<struct<side:int,digest:string>>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def position(level: int, index: int, n: int) -> int:
    """Place of node ``index`` of ``level`` in the postorder log over ``n`` leaves."""
    end = (index + 1) << level
    if end < n:
        # All subtrees complete at ``end``, less this node and those above it that end here too.
        return 2 * end - end.bit_count() - (((end & -end).bit_length() - 1) - level) - 1
    # The last leaf: one node of each level ends here, after all subtrees complete before it.
    return 2 * (n - 1) - (n - 1).bit_count() + level


def width(level: int, n: int) -> int:
    """Nodes of a level over ``n`` leaves."""
    return -(-n >> level) if n else 0


def height_of(n: int) -> int:
    """Levels above the leaves until one node remains."""
    return max(0, n - 1).bit_length()


def build(leaves: list[str], height: int) -> list[str]:
    """The log over ``leaves``: nodes in the order of their completion, up to ``height`` levels."""
    log: list[str] = []
    level = at = 0
    for i, leaf in enumerate(leaves):
        log.append(leaf)
        level, at = 0, i
        while at & 1:
            log.append(digest(log[position(level, at - 1, len(leaves))], log[-1]))
            level, at = level + 1, at >> 1
    while level < height:  # runs that the last leaf leaves incomplete
        log.append(digest(log[position(level, at - 1, len(leaves))], log[-1]) if at & 1 else digest(log[-1]))
        level, at = level + 1, at >> 1
    return log


def siblings(log: list[str], leaf: int, n: int, height: int) -> list[tuple[int, str | None]]:
    """(side, digest) per level, addressed by closed form."""
    out: list[tuple[int, str | None]] = []
    for level in range(height):
        other = (leaf >> level) ^ 1
        if other < width(level, n):
            out.append((RIGHT if other & 1 else LEFT, log[position(level, other, n)]))
        else:
            out.append((LONE, None))
    return out


def fold(node: str, path: list[tuple[int, str | None]]) -> str:
    """What ``node`` becomes at the end of a path."""
    for side, other in path:
        node = digest(node) if side == LONE else digest(other, node) if side == LEFT else digest(node, other)
    return node


def encoded(column: Column) -> Column:
    """``-`` for null, else byte count, colon, value; whole numbers in decimal."""
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*fields: Column) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


@dataclass
class Manifest:
    """``members`` (tree key, tree, block, i, id, leaf, changed), ``tiers`` of logs (tree, block, n,
    total, nodes), ``forest`` the same over the roots of the trees, ``trees`` (key, tree, total,
    subroot), ``root``."""

    members: DataFrame
    tiers: list[DataFrame]
    forest: list[DataFrame]
    trees: DataFrame
    root: str | None
    bits: int


def _height(total: int, bits: int) -> int:
    return height_of(total) if total <= 1 << bits else bits


def _logs(items: DataFrame, bits: int) -> DataFrame:
    """Logs (tree, block, n, total, nodes, top) of items (tree, i, total, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["tree", "block"]):
            tree, block, total = (group.column(c).to_pylist() for c in ("tree", "block", "total"))
            node = group.column("node").to_pylist()
            starts = [k for k in range(len(node)) if not k or (tree[k], block[k]) != (tree[k - 1], block[k - 1])]
            rows = []
            for lo, hi in zip(starts, [*starts[1:], len(node)]):
                log = build(node[lo:hi], _height(total[lo], bits))
                rows.append({"tree": tree[lo], "block": block[lo], "n": hi - lo, "total": total[lo], "nodes": log, "top": log[-1]})
            yield pa.RecordBatch.from_pylist(rows, schema=_LOG)

    blocks = items.select("tree", F.shiftright("i", bits).alias("block"), "i", "total", "node")
    return blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "i").mapInArrow(run, "tree long, block long, n long, total long, nodes array<string>, top string")


_LOG = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("total", pa.int64()), ("nodes", pa.list_(pa.string())), ("top", pa.string())])


def _tiers(items: DataFrame, most: int, bits: int) -> list[DataFrame]:
    """Stored logs of every tier, the lowest first, over trees of at most ``most`` items."""
    tiers = []
    while True:
        tiers.append(stored(_logs(items, bits), "merkle-log"))
        if most <= 1 << bits:
            return tiers
        most = width(bits, most)
        items = tiers[-1].where(F.col("total") > 1 << bits).select(
            "tree", F.col("block").alias("i"), F.ceil(F.col("total") / (1 << bits)).cast("long").alias("total"), F.col("top").alias("node")
        )


def _tops(tiers: list[DataFrame], bits: int) -> DataFrame:
    """(tree, top) of the trees: each ends in the tier where it has one block."""
    ends = [t.where(F.col("total") <= 1 << bits).select("tree", "top") for t in tiers]
    out = ends[0]
    for e in ends[1:]:
        out = out.union(e)
    return out


def build_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", tree_col: str = "lang", changed: dict[str, Column] | None = None, where: Column | None = None, bits: int = BITS) -> Manifest:
    """Build all logs of ``docs``. Leaves of a tree ascend by id (null first), those of one id by
    their digest, so the order of the input rows does not matter; trees ascend by their key, null
    first. Repeated rows are leaves of their own. ``changed`` gives other values of some fields,
    and ``where`` the rows whose leaf is also taken with these. Without rows there is no tree and
    the root is null. Nulls in any field are part of the leaf."""
    changed = changed or {}
    other = leaf_of(*[changed.get(f, F.col(f)) for f in fields])
    key = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit("-"))  # null first
    # Narrow rows are stored at once: the numbering reads its input more than once, the texts only here.
    narrow = stored(docs.select(key.alias("_key"), F.col(id_col).alias("_id"), leaf_of(*[F.col(f) for f in fields]).alias("leaf"), F.when(where if where is not None else F.lit(False), other).alias("changed")), "merkle-leaves")
    counts = stored(narrow.groupBy("_key").agg(F.count(F.lit(1)).alias("total")), "merkle-trees")
    trees = stored(number_rows(counts, ["_key"], "tree", "total", "first"), "merkle-trees")
    placed = number_rows(narrow, ["_key", "_id", "leaf", "changed"], "at").join(trees, "_key")
    members = stored(placed.select("_key", "tree", F.shiftright(F.col("at") - F.col("first"), bits).alias("block"), (F.col("at") - F.col("first")).alias("i"), "total", "_id", "leaf", "changed"), "merkle-members")
    size = trees.agg(F.coalesce(F.max("total"), F.lit(0)).alias("most"), F.count(F.lit(1)).alias("trees")).first()
    tiers = _tiers(members.select("tree", "i", "total", F.col("leaf").alias("node")), size.most, bits)
    tops = stored(_tops(tiers, bits), "merkle-tops")
    forest = _tiers(tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(size.trees).cast("long").alias("total"), F.col("top").alias("node")), size.trees, bits)
    root = _tops(forest, bits).first()  # one row: the forest is one tree
    return Manifest(members, tiers, forest, trees.join(tops, "tree").withColumnRenamed("top", "subroot"), root.top if root else None, bits)


def _paths(logs: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """Paths (tree, block, path) of a tier's blocks to those of its items, which are the blocks
    of the tier below: an item's siblings in its block, then the path of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for k in range(r["n"]):
                    near = siblings(r["nodes"], k, r["n"], _height(r["total"], bits))
                    rows.append({"tree": r["tree"], "block": (r["block"] << bits) + k, "path": [{"side": s, "digest": d} for s, d in near] + r["path"]})
            yield pa.RecordBatch.from_pylist(rows, schema=_PATHS)

    return logs.join(above, ["tree", "block"]).select("tree", "block", "n", "total", "nodes", "path").mapInArrow(run, f"tree long, block long, path {PATH}")


_PATHS = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("path", pa.list_(pa.struct([("side", pa.int32()), ("digest", pa.string())])))])


def block_paths(manifest: Manifest) -> DataFrame:
    """(tree, block, path) of every block of leaves: from its top up to the root."""
    bits = manifest.bits
    one = manifest.forest[-1].select("tree", "block", F.array().cast(PATH).alias("path"))  # the root's block
    for logs in reversed(manifest.forest):
        one = stored(_paths(logs, one, bits), "merkle-paths")
    ends = one.select(F.col("block").alias("tree"), F.lit(0).cast("long").alias("block"), "path")
    now = None
    for k, logs in reversed(list(enumerate(manifest.tiers))):
        here = logs.where(F.col("total") <= 1 << bits).select("tree", "block").join(ends, ["tree", "block"])
        now = here if now is None else here.union(now)
        if k:
            now = stored(_paths(logs, now, bits), "merkle-paths")
    return now


def proofs(manifest: Manifest) -> DataFrame:
    """(id, leaf, changed, subroot, path, folded, verified) per input row. ``path`` is the
    proof; ``folded`` is the root recomputed from the changed leaf, or else the leaf."""
    bits, root = manifest.bits, manifest.root
    # A block's members travel as one row beside its log: at most 2**bits of them.
    held = manifest.members.groupBy("tree", "block").agg(F.array_sort(F.collect_list(F.struct("i", "_id", "leaf", "changed"))).alias("_rows"))
    blocks = manifest.tiers[0].join(block_paths(manifest), ["tree", "block"]).join(held, ["tree", "block"]).join(manifest.trees.select("tree", "subroot"), "tree")
    kind = manifest.members.schema["_id"].dataType
    id_type = pa.field("_id", _arrow(kind))
    schema = pa.schema([id_type, ("leaf", pa.string()), ("changed", pa.string()), ("subroot", pa.string()), _PATHS.field("path"), ("folded", pa.string()), ("verified", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                height = _height(r["total"], bits)
                above = [(p["side"], p["digest"]) for p in r["path"]]
                tops: dict[str, str] = {}  # what a block top becomes at the root: mostly one value
                out = []
                for k, m in enumerate(r["_rows"]):
                    near = siblings(r["nodes"], k, r["n"], height)
                    top = fold(m["changed"] or m["leaf"], near)
                    if top not in tops:
                        tops[top] = fold(top, above)
                    out.append({
                        "_id": m["_id"], "leaf": m["leaf"], "changed": m["changed"], "subroot": r["subroot"],
                        "path": [{"side": s, "digest": d} for s, d in near] + r["path"], "folded": tops[top], "verified": tops[top] == root,
                    })
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    names = f"_id {kind.simpleString()}, leaf string, changed string, subroot string, path {PATH}, folded string, verified boolean"
    return blocks.select("n", "total", "nodes", "path", "_rows", "subroot").mapInArrow(run, names)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def log(manifest: Manifest) -> DataFrame:
    """(tree, position, node): the append log of every whole tree. Each tier's nodes are put at
    their closed-form places; a block's top is the leaf of the next tier and is listed once."""
    bits = manifest.bits
    totals = manifest.trees.select("tree", F.col("total").alias("_leaves"))

    def place(tier: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    rows = []
                    for level in range(0 if not tier else 1, _height(r["total"], bits) + 1):
                        for k in range(width(level, r["n"])):
                            index = (r["block"] << bits >> level) + k
                            rows.append({"tree": r["tree"], "position": position(level + bits * tier, index, r["_leaves"]), "node": r["nodes"][position(level, k, r["n"])]})
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows)

        return run

    out = None
    for tier, logs in enumerate(manifest.tiers):
        part = logs.join(totals, "tree").drop("top").mapInArrow(place(tier), "tree long, position long, node string")
        out = part if out is None else out.union(part)
    return out


def tampered(id_col: str = "doc_id", every: int = 7) -> Column:
    """Rows to tamper with: ``every`` divides the CRC-32 of the decimal id. A null id is left alone."""
    return F.col(id_col).isNotNull() & (F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(every)) == 0)


ORACLE = """
WITH RECURSIVE e AS (SELECT *, crc FROM (SELECT *, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda p: list_prepend(CAST(ascii(substr(CAST(doc_id AS VARCHAR), p, 1)) AS BIGINT), [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END) AS crc FROM documents)),
f AS (SELECT doc_id, lang, sha256(a || n || c) AS leaf, CASE WHEN n_chars IS NOT NULL AND xor(crc, 4294967295) % 7 = 0 THEN sha256(a || t || c) END AS bad
  FROM (SELECT *, concat_enc(CAST(doc_id AS VARCHAR)) || concat_enc(source) || concat_enc(lang) AS a, concat_enc(CAST(n_chars AS VARCHAR)) AS n, concat_enc(CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR)) AS t, concat_enc(text) AS c FROM e)),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM f),
up AS (SELECT lang, 0 AS lv, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM l
  UNION ALL SELECT lang, lv + 1, i // 2, sha256(h || coalesce(nx, '')), (n + 1) // 2 FROM (SELECT *, lead(h) OVER (PARTITION BY lang, lv ORDER BY i) AS nx FROM up WHERE n > 1) WHERE i % 2 = 0),
sub AS (SELECT lang, lv AS top, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k FROM up WHERE n = 1),
fo AS (SELECT 0 AS lv, k AS i, subroot AS h, count(*) OVER () AS n FROM sub
  UNION ALL SELECT lv + 1, i // 2, sha256(h || coalesce(nx, '')), (n + 1) // 2 FROM (SELECT *, lead(h) OVER (PARTITION BY lv ORDER BY i) AS nx FROM fo WHERE n > 1) WHERE i % 2 = 0),
steps AS (SELECT l.doc_id, l.lang, l.i AS leaf_i, p.lv AS s, (l.i >> p.lv) & 1 AS odd, u.h
  FROM l JOIN sub ON sub.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT DISTINCT lv FROM up) p ON p.lv < sub.top
  LEFT JOIN up u ON u.lang IS NOT DISTINCT FROM l.lang AND u.lv = p.lv AND u.i = xor(l.i >> p.lv, 1)
  UNION ALL SELECT l.doc_id, l.lang, l.i, 1000 + p.lv, (sub.k >> p.lv) & 1, u.h
  FROM l JOIN sub ON sub.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT DISTINCT lv FROM fo WHERE n > 1) p ON true
  LEFT JOIN fo u ON u.lv = p.lv AND u.i = xor(sub.k >> p.lv, 1)),
g AS (SELECT lang, leaf_i, list(CASE WHEN h IS NULL THEN '-' WHEN odd = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY s) AS path, string_agg(coalesce(h, ''), '' ORDER BY s) AS proof FROM steps GROUP BY lang, leaf_i),
r AS (SELECT h AS root FROM fo WHERE n = 1),
v AS (SELECT l.doc_id, l.leaf, sub.subroot, r.root, sha256(coalesce(g.proof, '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(l.bad, l.leaf), coalesce(g.path, [])), lambda a, b: sha256(CASE b[1] WHEN '-' THEN a WHEN 'L' THEN b[2:] || a ELSE a || b[2:] END)) AS folded_root
  FROM l JOIN sub ON sub.lang IS NOT DISTINCT FROM l.lang CROSS JOIN r LEFT JOIN g ON g.lang IS NOT DISTINCT FROM l.lang AND g.leaf_i = l.i)
SELECT *, folded_root = root AS verified FROM v"""


def oracle() -> str:
    """The SQL counterpart, with the field encoding written out."""
    import re

    return re.sub(r"concat_enc\((CAST\((?:[^()]|\([^()]*\))*\)|\w+)\)", r"coalesce(octet_length(encode(\1)) || ':' || \1, '-')", ORACLE)
