"""A Merkle manifest of a dataset, by checkpoint and recompute, in DataFrame operations.

Every row is a leaf; the leaves of a source, in order, form a tree whose nodes digest `ARITY` consecutive ones, and the
roots of the sources form a tree of the same kind. Only every `stride`-th level is persisted. A proof needs the nodes
between: extraction goes down from the root, one stored level at a time; the stored descendants of each aligned subtree
(ARITY ** stride nodes at most) come together, its missing interior nodes are computed again, every member gets its
siblings in each of them, and the interior nodes are dropped.

No source is gathered: places come from a range partitioning that may cut a source anywhere, and what meets in a group is
one aligned subtree.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, table

ARITY = 3
STRIDE = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields, each with its length before it, so that no two rows have the same bytes."""
    return F.sha2(F.concat(*map(field, fields)), 256)


@dataclass(frozen=True)
class Manifest:
    """levels: the stored levels of the sources' trees, leaves first, as (tree, idx, digest, n), n nodes of the tree at
    this level; levels[0] has the leaves' own columns too. subroots: (tree, level, digest). top: the stored levels above
    the subroots. tree is '' for a null source, else the source after an s. Digests are 32 bytes."""

    levels: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: str | None
    arity: int
    stride: int


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree, ...) with idx, the place of each in its tree by order, and n, the size of the tree. Ranges are cut by
    tree and order alike, so a large tree is many ranges; only a row for each range and tree goes through windows."""
    keys = [F.asc_nulls_first(c) for c in ("tree", *order)]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = materialize(ordered.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "ordered")
    cuts = ordered.groupBy("part", "tree").agg(F.count("*").alias("rows"), F.min("seq").alias("first"))
    of_tree = Window.partitionBy("tree")
    earlier = F.coalesce(F.sum("rows").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = materialize(cuts.select("part", "tree", (earlier - F.col("first")).alias("shift"), F.sum("rows").over(of_tree).alias("n")), "cuts")
    cuts = broadcast_if_small(cuts, F.octet_length("tree") + 64)
    return ordered.join(cuts, ["part", "tree"]).withColumn("idx", F.col("seq") + F.col("shift")).drop("part", "seq", "shift")


def _interior(digests: Column, n: Column, arity: int, stride: int) -> Column:
    """Of an aligned subtree: levels (the hex digests of its lowest level and those between, while the tree has several
    nodes), digests (what is above them) and n (nodes of the whole tree there)."""

    def up(state: Column, _: Column) -> Column:
        runs = F.sequence(F.lit(0), F.ceil(F.size(state["digests"]) / arity).cast("int") - 1)
        above = F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(state["digests"], i * arity + 1, F.lit(arity)), ""), 256))
        several = state["n"] > 1
        return F.struct(
            F.when(several, F.concat(state["levels"], F.array(state["digests"]))).otherwise(state["levels"]).alias("levels"),
            F.when(several, above).otherwise(state["digests"]).alias("digests"),
            F.when(several, F.ceil(state["n"] / arity).cast("long")).otherwise(state["n"]).alias("n"),
        )

    begin = F.struct(F.array().cast("array<array<string>>").alias("levels"), digests.alias("digests"), n.cast("long").alias("n"))
    return F.aggregate(F.array(*map(F.lit, range(stride))), begin, up)


def _subtrees(nodes: DataFrame, arity: int, stride: int, carried: list[str]) -> DataFrame:
    """(tree, block, members in order, interior) of the aligned subtrees that start at nodes."""
    block = F.floor(F.col("idx") / F.lit(arity**stride)).cast("long")
    members = F.array_sort(F.collect_list(F.struct("idx", "digest", *carried)))
    groups = nodes.groupBy("tree", block.alias("block")).agg(F.max("n").alias("n"), members.alias("members"))
    return groups.withColumn("interior", _interior(F.transform("members", lambda m: _hex(m["digest"])), F.col("n"), arity, stride))


def _climb(nodes: DataFrame, arity: int, stride: int) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels above nodes (tree, idx, digest, n), nodes first, and each tree's root with its level."""
    levels = [nodes]
    while True:
        below = levels[-1].where("n > 1") if len(levels) > 1 else nodes
        made = _subtrees(below.select("tree", "idx", "digest", "n"), arity, stride, [])
        above = made.select("tree", F.col("block").alias("idx"), F.unhex(F.col("interior.digests")[0]).alias("digest"), F.col("interior.n").alias("n"))
        levels.append(materialize(above, f"level{len(levels)}"))
        if levels[-1].where("n > 1").isEmpty():
            break
    roots = (level.where("n = 1").select("tree", F.lit(j).alias("level"), "digest") for j, level in enumerate(levels) if j)
    return levels, reduce(DataFrame.unionByName, roots)


def build(leaves: DataFrame, order: list[str], source: str = "source", arity: int = ARITY, stride: int = STRIDE) -> Manifest:
    """The manifest of a table of leaves: `source`, the columns of order, leaf (hex) and others, which are carried.

    The leaves of a source ascend by order, nulls first, then by leaf, and repeated rows are neighbours; a null source is
    a source of its own, the first. A source of one leaf has it as its subroot, and one source's subroot is the root. The
    manifest of an empty table has no root. Columns named tree, idx, digest, n and the like are replaced.
    """
    tree = F.coalesce(F.concat(F.lit("s"), source), F.lit(""))
    own = [c for c in leaves.columns if c not in ("leaf", "tree", "idx", "digest", "n", "copy", "part", "seq", "shift")]
    # copy tells repeated rows apart, so that a range may end between them.
    rows = materialize(leaves.select(*own, tree.alias("tree"), F.unhex("leaf").alias("digest"), F.monotonically_increasing_id().alias("copy")), "leaves")
    nodes = materialize(_numbered(rows, [*order, "digest", "copy"]).drop("copy"), "level0")
    levels, subroots = _climb(nodes, arity, stride)
    subroots = materialize(subroots, "subroots")
    heads = _numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "level", "digest"), ["name"])
    top, roots = _climb(materialize(heads, "heads"), arity, stride)
    found = roots.select(_hex(F.col("digest"))).first()
    return Manifest(levels, subroots, top, found[0] if found else None, arity, stride)


def _paths(levels: list[DataFrame], above: DataFrame, arity: int, stride: int, carried: list[str]) -> DataFrame:
    """(tree, idx, digest, path, subroot, carried columns) of levels[0]: path lists, level by level up to the root, the
    siblings left and right. above: (tree, level, path, subroot), what is above each tree's root."""
    paths = None
    for j in range(len(levels) - 2, -1, -1):
        parents = above.where(F.col("level") == j + 1).select("tree", F.lit(0).cast("long").alias("block"), F.col("path").alias("further"), "subroot")
        if paths is not None:
            parents = paths.select("tree", F.col("idx").alias("block"), F.col("path").alias("further"), "subroot").unionByName(parents)
        own = carried if j == 0 else []
        below = levels[j].where("n > 1") if j else levels[0]
        groups = _subtrees(below.select("tree", "idx", "digest", "n", *own), arity, stride, own).join(parents, ["tree", "block"])
        each = groups.select("tree", "further", "subroot", F.col("interior.levels").alias("inside"), F.posexplode("members").alias("at", "member"))
        spans = F.array(*(F.lit(arity**t) for t in range(stride)))

        def beside(nodes: Column, t: Column) -> Column:
            at = F.floor(F.col("at") / F.element_at(spans, t + 1)).cast("int")  # noqa: B023
            nth = at % arity
            return F.struct(
                F.array_join(F.slice(nodes, at - nth + 1, nth), "").alias("left"),
                F.array_join(F.slice(nodes, at + 2, F.lit(arity - 1) - nth), "").alias("right"),
            )

        path = F.concat(F.transform("inside", beside), F.col("further"))
        paths = each.select("tree", "member.idx", "member.digest", path.alias("path"), "subroot", *(F.col("member")[c].alias(c) for c in own))
        if j:
            paths = materialize(paths, f"paths{j}")
    return paths


def proofs(manifest: Manifest, only: DataFrame | None = None) -> DataFrame:
    """Each leaf's own columns, tree, idx, leaf, subroot, root and path: an array, from the leaf's level up, of its
    siblings' hex digests as (left, right). only: (tree, idx) of the leaves to prove; the subtrees of others are not read
    out of their groups."""
    m = manifest
    empty = F.array().cast("array<struct<left:string,right:string>>")
    last = m.top[-1].where("n = 1").select("tree", F.lit(len(m.top) - 1).alias("level"), empty.alias("path"), F.lit("").alias("subroot"))
    heads = _paths(m.top, last, m.arity, m.stride, ["name", "level"])
    above = materialize(heads.select(F.col("name").alias("tree"), "level", "path", _hex(F.col("digest")).alias("subroot")), "above")
    own = [c for c in m.levels[0].columns if c not in ("tree", "idx", "digest", "n")]
    levels = m.levels
    if only is not None:
        block = F.floor(F.col("idx") / F.lit(m.arity**m.stride)).alias("block")
        wanted = only.select("tree", block).distinct()
        levels = [levels[0].withColumn("block", block).join(wanted, ["tree", "block"], "left_semi").drop("block"), *levels[1:]]
    found = _paths(levels, above, m.arity, m.stride, own)
    if only is not None:
        found = found.join(only.select("tree", "idx").distinct(), ["tree", "idx"], "left_semi")
    return found.select(*own, "tree", "idx", _hex(F.col("digest")).alias("leaf"), "subroot", F.lit(m.root).alias("root"), "path")


def proof_text(path: Column) -> Column:
    """All siblings of a proof in their order, as one text."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def tampered_text(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(""))


def query(spark, sf_dir):
    """A null doc_id counts as the empty text where its parity is taken."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in FIELDS]
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    changed = even & F.contains("text", F.lit("\n"))
    other = F.when(changed, F.unhex(leaf([*fields[:-1], tampered_text(F.col("text"))])))
    leaves = docs.select("doc_id", "source", leaf(fields).alias("leaf"), other.alias("tampered"))
    found = proofs(build(leaves, ["doc_id"]))
    found = found.withColumn("folded_root", folded(F.coalesce(_hex(F.col("tampered")), "leaf"), F.col("path")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


_LEAF = "sha256({})"
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),"
    " lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)))))"
)
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_LEAF.format(" || ".join(map(_field_sql, FIELDS)))} AS leaf,
         CASE WHEN {_CRC} % 2 = 0 THEN {_LEAF.format(" || ".join([*map(_field_sql, FIELDS[:-1]), _field_sql("replace(text, chr(10), '')")]))} END AS tampered
  FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
t(lvl, source, i, h, n) AS (
  SELECT 0, source, i, leaf, n FROM l
  UNION ALL
  SELECT lvl, source, i, h, (n + 2) // 3 FROM (
    SELECT lvl + 1 AS lvl, source, i // 3 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, max(n) AS n FROM t WHERE n > 1 GROUP BY lvl, source, i // 3)),
s AS (SELECT source, h AS subroot, lvl AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, i, h, n) AS (
  SELECT 0, i, subroot, n FROM s
  UNION ALL
  SELECT lvl, i, h, (n + 2) // 3 FROM (
    SELECT lvl + 1 AS lvl, i // 3 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, max(n) AS n FROM u WHERE n > 1 GROUP BY lvl, i // 3)),
r AS (SELECT h AS root, lvl AS height FROM u WHERE n = 1),
tr AS (SELECT lvl, source, i // 3 AS run, list(h ORDER BY i) AS hs FROM t WHERE n > 1 GROUP BY lvl, source, i // 3),
ur AS (SELECT lvl, i // 3 AS run, list(h ORDER BY i) AS hs FROM u WHERE n > 1 GROUP BY lvl, i // 3),
step AS (
  SELECT l.doc_id, l.source, l.i AS leaf_i, k AS lvl, (l.i // (3 ** k)::BIGINT % 3)::INT AS nth, tr.hs
  FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source, unnest(range(s.height)) AS ks(k)
  JOIN tr ON tr.lvl = k AND tr.source IS NOT DISTINCT FROM l.source AND tr.run = l.i // (3 ** (k + 1))::BIGINT
  UNION ALL
  SELECT l.doc_id, l.source, l.i, s.height + k, (s.i // (3 ** k)::BIGINT % 3)::INT, ur.hs
  FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source, r, unnest(range(r.height)) AS ks(k)
  JOIN ur ON ur.lvl = k AND ur.run = s.i // (3 ** (k + 1))::BIGINT),
p AS (
  SELECT source, leaf_i, list({{'l': list_aggregate(hs[:nth], 'string_agg', ''), 'r': list_aggregate(hs[nth + 2:], 'string_agg', '')}} ORDER BY lvl) AS path
  FROM step GROUP BY source, leaf_i),
f AS (
  SELECT l.doc_id, l.leaf, s.subroot, r.root, coalesce(p.path, []) AS path, coalesce(l.tampered, l.leaf) AS changed
  FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source CROSS JOIN r LEFT JOIN p ON p.source IS NOT DISTINCT FROM l.source AND p.leaf_i = l.i),
g AS (
  SELECT doc_id, leaf, subroot, root,
         sha256(coalesce(list_aggregate(list_transform(path, lambda x: coalesce(x.l, '') || coalesce(x.r, '')), 'string_agg', ''), '')) AS proof_sha256,
         list_reduce(list_prepend(changed, list_transform(path, lambda x: coalesce(x.l, '') || '|' || coalesce(x.r, ''))),
           lambda h, x: sha256(string_split(x, '|')[1] || h || string_split(x, '|')[2])) AS folded_root
  FROM f)
SELECT *, folded_root = root AS verified FROM g
"""
