"""A Merkle manifest of a dataset: a digest for each row, subtree and language, one root, and a proof for each row.

Leaves are ranked within their language (a range shuffle and prefix counts) and dealt to aligned blocks of
``FAN ** height``. A block is traversed recursively in postorder: a call returns its subtree's digest and, while unwinding,
appends the siblings to the leaves contained. The blocks' roots, again ranked within their language, are the leaves of the
next distributed traversal, until one node a language is left; these subroots are traversed likewise to the root. Back on
the way down each block gets the path above it by a join and hands it on to its own leaves.

A block is one row of arrays (its nodes' names and digests), so that the shuffles between traversals carry digests, no
texts and no paths of single leaves; at most ``FAN ** height`` leaves meet in one call.

Null texts and fields count as ``-``; null ``doc_id`` come first and are never tampered with; null ``lang`` is a language
of its own and comes first. Repeated ``doc_id`` go by their leaves' digests, and rows equal in both are interchangeable;
each gets its own place and proof. Very long texts are digested whole in the JVM; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, materialise, own, read

FAN = 8
HEIGHT = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<place: int, others: array<string>>>"
PROVEN = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[_field(text if c == "text" else F.col(c)) for c in FIELDS]).cast("binary"), 256)


def visit(nodes: list[str], low: int, high: int, height: int, paths: list[list]) -> str:
    """The digest of the subtree of ``height`` over ``nodes[low:high]``. Appends (place in the run, siblings) to the path
    of every node contained. A run may have fewer than ``FAN`` nodes, even one."""
    if height == 0:
        return nodes[low]
    step = FAN ** (height - 1)
    starts = range(low, high, step)
    children = [visit(nodes, a, min(a + step, high), height - 1, paths) for a in starts]
    for k, a in enumerate(starts):
        entry = {"place": k, "others": children[:k] + children[k + 1 :]}
        for i in range(a, min(a + step, high)):
            paths[i].append(entry)
    return digest(children)


def fold(start: str, path: list[dict]) -> str:
    """The root that a leaf and its path give."""
    for step in path:
        k, others = step["place"], step["others"]
        start = digest([*others[:k], start, *others[k:]])
    return start


def _height(total: int, most: int) -> int:
    """Levels of a block in a tree of ``total`` nodes: ``most`` if it is one of several, else as many as the tree has."""
    height = 0
    while FAN**height < total and height < most:
        height += 1
    return height


def ranked(nodes: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``nodes`` with their ``rank`` within ``tree`` (from 0) and the tree's ``total``. What comes by the range shuffle is
    written once, so that all jobs see the same ranges; equal rows are parted by a number of their own."""
    spread = nodes.withColumn("_own", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(tree, *order, "_own").withColumn("_part", F.spark_partition_id())
    fields = [*nodes.columns, "_part"]

    def number(batches):
        last, at = None, 0
        for batch in batches:
            keys, places = batch.column(fields.index(tree)).to_pylist(), []
            for key in keys:
                last, at = key, at + 1 if key == last else 0
                places.append(at)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields), pa.array(places, pa.int64())], [*fields, "_at"])

    schema = ", ".join(f"{c} {kind}" for c, kind in spread.select(*fields).dtypes)
    placed = materialise(spread.sortWithinPartitions(tree, *order, "_own").select(*fields).mapInArrow(number, f"{schema}, _at long"))
    # a row for each range and tree; the last of a tree's ranges knows its total
    sizes = placed.groupBy(tree, "_part").agg(F.count("*").alias("_n"))
    one = Window.partitionBy(tree)
    sizes = sizes.select(tree, "_part", (F.sum("_n").over(one.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(one).alias("total"))
    return placed.join(sizes, [tree, "_part"]).select(*nodes.columns, (F.col("_before") + F.col("_at")).alias("rank"), "total")


def blocks(nodes: DataFrame, named: dict[str, str], most: int) -> DataFrame:
    """Rows (tree, block, height, names.., digests, root, total), one for each aligned block of ``FAN ** most`` of the
    ``nodes`` (tree, rank, total, digest and the columns ``named``)."""
    size = FAN**most
    schema = f"tree string, block long, height int, {', '.join(f'{c} array<{kind}>' for c, kind in named.items())}, digests array<string>, root string, total long"

    def build(key, group):
        group = group.sort_by("rank")
        digests, total = group["digest"].to_pylist(), group["total"][0].as_py()
        height = _height(total, most)
        root = visit(digests, 0, len(digests), height, [[] for _ in digests])
        row = {"tree": key[0].as_py(), "block": key[1].as_py(), "height": height, **{c: group[c].to_pylist() for c in named}, "digests": digests, "root": root, "total": -(-total // size)}
        return pa.Table.from_pylist([row], schema=pa.schema([(c, kinds[c]) for c in row]))

    arrow = {"string": pa.string(), "long": pa.int64()}
    kinds = {"tree": pa.string(), "block": pa.int64(), "height": pa.int32(), "digests": pa.list_(pa.string()), "root": pa.string(), "total": pa.int64()} | {c: pa.list_(arrow[kind]) for c, kind in named.items()}
    dealt = nodes.withColumn("block", F.floor(F.col("rank") / size))
    return materialise(dealt.groupBy("tree", "block").applyInArrow(build, schema))


def climb(level: DataFrame, most: int) -> list[DataFrame]:
    """``level`` and the levels of blocks above it; the last has one block for each tree. A tree that ends below keeps its
    root: a lone node gets no run of its own."""
    levels = [level]
    while not levels[-1].where("total > 1").isEmpty():
        nodes = levels[-1].select("tree", F.col("block").alias("rank"), "total", F.col("root").alias("digest"))
        levels.append(blocks(nodes, {"rank": "long"}, most))
    return levels


_STEPS = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))
_HANDED = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("path", _STEPS), ("subroot", pa.string()), ("root", pa.string())])
HANDED = f"tree string, block long, path {PATH}, subroot string, root string"


def _unwound(block: pa.Table) -> tuple[dict, list[list]]:
    """A block's row and the path within it of each of its nodes."""
    row = block.to_pylist()[0]
    paths: list[list] = [[] for _ in row["digests"]]
    visit(row["digests"], 0, len(paths), row["height"], paths)
    return row, paths


def _hand_down(level: DataFrame, above: DataFrame) -> DataFrame:
    """From the paths above the blocks of ``level`` to those above its nodes, which are blocks of the level below (or,
    named, the only block of a tree)."""

    def hand(block, upper):
        (row, paths), top = _unwound(block), upper.to_pylist()[0]
        if "name" in row:
            out = [{"tree": name, "block": 0, "path": p + top["path"], "subroot": d, "root": top["root"]} for name, d, p in zip(row["name"], row["digests"], paths, strict=True)]
        else:
            out = [{"tree": row["tree"], "block": k, "path": p + top["path"], "subroot": top["subroot"], "root": top["root"]} for k, p in zip(row["rank"], paths, strict=True)]
        return pa.Table.from_pylist(out, schema=_HANDED)

    return level.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(hand, HANDED)


def _prove(block, upper):
    (row, paths), top = _unwound(block), upper.to_pylist()[0]
    above, out = "".join(x for step in top["path"] for x in step["others"]), []
    for doc_id, leaf_digest, forged, path in zip(row["doc_id"], row["digests"], row["forged"], paths, strict=True):
        own_root = fold(forged or leaf_digest, path + top["path"])
        proof = digest([*(x for step in path for x in step["others"]), above])
        out.append({"doc_id": doc_id, "leaf": leaf_digest, "subroot": top["subroot"], "root": top["root"], "proof_sha256": proof, "folded_root": own_root, "verified": own_root == top["root"]})
    return pa.Table.from_pylist(out, schema=_PROVEN)


_PROVEN = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])


def manifest(docs: DataFrame, tampered: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row. ``tampered``: the text that a
    proof is checked with, where it is not null; the leaf it gives is folded with the untampered siblings. Blocks have
    ``FAN ** height`` leaves."""
    forged = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf(tampered))
    # null comes first; all other languages, the empty one included, start with a mark
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    leaves = own(docs, *FIELDS).select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("digest"), forged.alias("forged"))
    levels = climb(blocks(ranked(leaves, "tree", ["doc_id", "digest"]), {"doc_id": "long", "forged": "string"}, height), height)
    subroots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    tops = climb(blocks(ranked(subroots, "tree", ["name"]), {"name": "string"}, height), height)
    # written anew: a cogroup mistakes columns of one origin on both sides
    above = materialise(tops[-1].select("tree", "block", F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"), "root"))
    for level in [*tops[::-1], *levels[:0:-1]]:
        above = _hand_down(level, above)
    return levels[0].groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(_prove, PROVEN)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(read(spark, sf_dir, "documents"), F.when(chosen, F.translate("text", UPPER, UPPER.lower())))


def _climb_sql(prefix: str, tree: str) -> list[str]:
    """CTEs ``{prefix}1``, ``{prefix}2``.. of levels over ``{prefix}0`` (tree, i, h, n: the tree's nodes), and of what a
    node's run has before and after it. A lone node stays as it is."""
    found = []
    for k in range(LEVELS):
        found.append(f"""{prefix}s{k} as (select a.{tree}, a.i, a.n, a.h, a.i // {FAN} as up, a.i % {FAN} as place,
  coalesce(string_agg(b.h, '' order by b.i) filter (b.i < a.i), '') as lefts, coalesce(string_agg(b.h, '' order by b.i) filter (b.i > a.i), '') as rights
  from {prefix}{k} a join {prefix}{k} b on a.{tree} = b.{tree} and a.i // {FAN} = b.i // {FAN} group by a.{tree}, a.i, a.n, a.h)""")
        found.append(f"""{prefix}{k + 1} as (select {tree}, up as i, case when any_value(n) = 1 then any_value(h) else sha256(string_agg(h, '' order by i)) end as h,
  (any_value(n) + {FAN - 1}) // {FAN} as n from {prefix}s{k} group by {tree}, up)""")
    return found


def _fold_sql(prefix: str, tree: str, source: str, name: str) -> list[str]:
    """CTEs that fold ``source`` (key, tree, i, h, proof) up through the levels of ``prefix``; the last is called ``name``."""
    found = []
    for k in range(LEVELS):
        found.append(f"""{name}{k + 1} as (select f.key, f.{tree}, f.i // {FAN} as i, case when s.n = 1 then f.h else sha256(s.lefts || f.h || s.rights) end as h,
  f.proof || s.lefts || s.rights as proof from {source if k == 0 else f"{name}{k}"} f join {prefix}s{k} s on s.{tree} = f.{tree} and s.i = f.i)""")
    return found


#: Levels that the SQL unrolls: enough for 8 ** 6 rows a language.
LEVELS = 6
_HASHED = "sha256(" + " || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_CRC = """list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(cast(doc_id as varchar)) + 1), lambda p: ord(substr(cast(doc_id as varchar), p, 1))::bigint)),
  lambda c, b: xor(c >> 8, list_reduce(list_prepend(xor(c, b) & 255, range(8)), lambda v, _: xor(v >> 1, 3988292384 * (v & 1)))))"""
ORACLE = f"""with l as (select row_number() over () as key, doc_id, coalesce('=' || lang, '') as tree, {_HASHED.format(text="text")} as leaf,
  case when xor({_CRC}, 4294967295) % 3 = 0 then {_HASHED.format(text=f"translate(text, '{UPPER}', '{UPPER.lower()}')")} end as forged from documents),
r as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by tree) as n from l),
a0 as (select tree, i, leaf as h, n from r), {", ".join(_climb_sql("a", "tree"))},
t as (select tree as name, '' as top, h, row_number() over (order by tree) - 1 as i, count(*) over () as n from a{LEVELS}),
b0 as (select top, i, h, n from t), {", ".join(_climb_sql("b", "top"))},
f0 as (select key, tree, i, coalesce(forged, leaf) as h, '' as proof from r), {", ".join(_fold_sql("a", "tree", "f0", "f"))},
g0 as (select f.key, '' as top, t.i, f.h, f.proof from f{LEVELS} f join t on t.name = f.tree), {", ".join(_fold_sql("b", "top", "g0", "g"))}
select r.doc_id, r.leaf, t.h as subroot, b.h as root, sha256(g.proof) as proof_sha256, g.h as folded_root, g.h = b.h as verified
from r join t on t.name = r.tree join g{LEVELS} g on g.key = r.key cross join b{LEVELS} b"""
