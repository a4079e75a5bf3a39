"""Merkle manifest of a table of documents, with a proof of every row.

Rows are leaves of one tree per language, and the languages' roots leaves of a
last tree. Nodes are numbered without gaps, by ranges, never in one window. A
shuffle climbs four levels: conditional aggregates spread the 16 nodes under
one parent into a column each, pairs of columns are concatenated and hashed,
level by level, and what is kept of a parent is that row. Neighbours stand in
the same partition, so nearly all of it is aggregated before the shuffle, and
the tables of all climbs together are a fifteenth of the leaves. On the way
down a parent's row is unfolded again: each slot's siblings are the columns of
its run without its own, and the parent's own proof is appended. Only joins
between parents are needed, so no proof of a leaf is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.base import attach, running_before, stage

#: Children of a node, and levels that one shuffle climbs.
FANOUT, LEVELS = 2, 4
#: Every one of so many row digests is tampered with, as a self-test.
TAMPER = 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _placed(nodes: DataFrame, order: list[str], fanout: int, name: str) -> DataFrame:
    """`nodes` (tree, node, ...) with `at`, their number within the tree, and the tree's `height`.

    The height is how often runs of `fanout` nodes are hashed until one node remains.
    """
    placed = running_before(nodes, ["tree"], order, F.lit(1), "at", name)
    powers = ", ".join(f"{fanout**k}L" for k in range(64) if fanout**k < 1 << 62)
    height = F.expr(f"size(filter(array({powers}), p -> p < count(1)))")
    return attach(placed, stage(nodes.groupBy("tree").agg(height.alias("height")), f"{name}-heights"), ["tree"], "inner")


def _hashed(row: Column, fanout: int) -> Column:
    """The hashes of the runs of `fanout` nodes of a level."""
    runs = F.sequence(F.lit(0), F.floor((F.size(row) - 1) / fanout).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(row, i * fanout + 1, fanout), "").cast("binary"), 256))


def _climb(nodes: DataFrame, fanout: int, levels: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The staged parents of each climb, lowest first, and (tree, root).

    `nodes` has tree, at, height, node and whatever the leaves carry, which is kept
    in the slots of the first climb. A parent has `slots`, its children in
    order, and `rows`, the hashes of each level from its children up.
    """
    width, climbs, done = fanout**levels, [], 0
    carried = [c for c in nodes.columns if c not in ("tree", "at", "height")]
    while True:
        up, slot = F.floor(F.col("at") / width).cast("long"), F.pmod("at", F.lit(width))
        columns = [F.max(F.when(slot == i, F.struct(*carried))).alias(f"s{i}") for i in range(width)]
        wide = nodes.groupBy("tree", "height", up.alias("up")).agg(*columns).withColumnRenamed("up", "at")
        held = wide.select("tree", "height", "at", F.filter(F.array(*[f"s{i}" for i in range(width)]), lambda s: s.isNotNull()).alias("slots"))
        held = held.withColumn("r0", F.transform("slots", lambda s: s["node"]))
        for level in range(levels):
            row = F.col(f"r{level}")
            held = held.withColumn(f"r{level + 1}", F.when(F.col("height") > done + level, _hashed(row, fanout)).otherwise(row))
        climbs.append(stage(held, f"{name}-{len(climbs)}"))
        done += levels
        nodes = climbs[-1].select("tree", "at", "height", F.col(f"r{levels}")[0].alias("node"))
        carried = ["node"]
        if climbs[-1].where("at > 0").isEmpty():
            return climbs, nodes.select("tree", F.col("node").alias("root"))


def _steps(fanout: int, levels: int, done: int) -> Column:
    """The proof of slot `slot` within its parent: what stands left and right of it in its run, level by level."""
    steps = []
    for level in range(levels):
        own = F.floor(F.col("slot") / F.lit(fanout**level)).cast("int")
        begin = own - own % fanout
        row = F.col(f"r{level}")
        left = F.array_join(F.slice(row, begin + 1, own % fanout), "")
        right = F.array_join(F.slice(row, own + 2, begin + fanout - 1 - own), "")
        steps.append(F.when(F.col("height") > done + level, F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def _descend(climbs: list[DataFrame], above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The leaves of all trees with `path`, their steps up to the root, and the columns of `above`.

    `above` has tree, `path`, the steps that follow those of the tree, and more.
    """
    more = [c for c in above.columns if c not in ("tree", "path")]
    held = above.withColumn("at", F.lit(0).cast("long"))
    for k in range(len(climbs) - 1, -1, -1):
        parents = climbs[k].join(held, ["tree", "at"])
        each = parents.select("*", F.posexplode("slots").alias("slot", "child"))
        path = F.concat(_steps(fanout, levels, k * levels), F.col("path"))
        place = (F.col("at") * fanout**levels + F.col("slot")).cast("long")
        held = each.select("tree", place.alias("at"), path.alias("path"), *more, *([] if k else ["child"]))
    return held.select("tree", "at", "path", *more, "child.*")


def manifest(docs: DataFrame, fanout: int = FANOUT, tamper: int = TAMPER, levels: int = LEVELS) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the hash of doc_id, source, lang, n_chars and text, null told
    from empty. Leaves of a language stand in order of doc_id, null first;
    rows that share an id in order of their leaf, so repeated rows, which are
    alike, stand together and each has its own place and proof. While a level
    has several nodes every `fanout` consecutive ones become their hash, the
    last run may be shorter, even of one. Languages stand in order of their
    bytes, null first. The proof is the hash of all siblings from the leaf's
    level to the root's, left to right; a table of one row has none, hence the
    hash of nothing. Rows where `tamper` divides crc32(doc_id) are folded from
    a leaf whose n_chars, if not null, is one larger; a null id is never
    tampered with. Long texts are hashed whole, columns beyond the five are not
    read, whatever they are called, and an empty table gives no rows.
    """
    c = {name: F.col(name) for name in COLUMNS}
    leaf = digest(*[field(c[name]) for name in COLUMNS])
    odd = F.coalesce((F.crc32(c["doc_id"].cast("string").cast("binary")) % tamper == 0) & c["n_chars"].isNotNull(), F.lit(False))
    more = (c["n_chars"].cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    changed = digest(*[field(more if name == "n_chars" else c[name]) for name in COLUMNS])
    tree = F.when(c["lang"].isNull(), "n").otherwise(F.concat(F.lit("s"), c["lang"]))
    leaves = stage(docs.select(c["doc_id"].cast("long").alias("doc_id"), tree.alias("tree"), leaf.alias("node"), F.when(odd, changed).alias("changed")), "leaves")
    climbs, subroots = _climb(_placed(leaves, ["doc_id", "node"], fanout, "leaf-order"), fanout, levels, "parents")
    tops = stage(subroots.select(F.lit("all").alias("tree"), F.col("tree").alias("lang"), F.col("root").alias("node")), "subroots")
    last, roots = _climb(_placed(tops, ["lang"], fanout, "root-order"), fanout, levels, "root-parents")
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    above = _descend(last, roots.select("tree", "root", nothing.alias("path")), fanout, levels)
    above = stage(above.select(F.col("lang").alias("tree"), "path", "root", F.col("node").alias("subroot")), "root-proofs")
    found = _descend(climbs, above, fanout, levels)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("path", F.coalesce("changed", "node"), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))
    rows = found.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
