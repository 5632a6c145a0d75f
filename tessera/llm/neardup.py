"""MinHash near-duplicate linking through an inverted index of signature coordinates.

1. Every text becomes its set of hashed word shingles and ``SKETCH`` minimum hashes of it. ``WIDTH`` of these make one
   coordinate of the signature, so that texts with some common phrases seldom collide; four bits of each hash make the
   sketch. Documents with the same set are one node from here on, named by their smallest ``doc_id``.
2. Nodes are posted under each coordinate-value pair. Pairs that one node alone has cannot collide and are skipped. A
   link at the asked similarity agrees on ``least_matches`` coordinates or more (it misses that with probability below
   1e-6), so, with each node's coordinates ordered from rare to frequent, two linked nodes share one of the first
   ``COORDINATES - matches + 1``: only that prefix is merged. Nodes that collide on fewer coordinates than a link needs
   are done here; only the others' texts are read again, once, for their full sets.
3. In each of ``ROUNDS`` rounds a list links its nodes to one of them, its hub: the smallest node at first, later one
   that is drawn for the list and the round. A node meets as many hubs as it has lists and is never paired with its own
   component again, so a group of thousands of copies costs thousands of checks.
4. In lists that still hold several components, the nodes outside the largest meet those of other components. A list
   with many such nodes is split by the size of the sets; then both sides are cut into blocks of bounded size, and a task
   compares two blocks. No pair becomes a row: the sketches' blocks give the nodes that have a partner, and blocks of
   those nodes' full sets give one link for each node and component.
5. Collisions are counted on the sketches; survivors are confirmed on the full sets.
6. Components grow by star contraction over the confirmed links.

A null ``doc_id`` is linked with nothing and kept. Null and empty texts have an empty set and are linked with nothing.
Texts of fewer words than a shingle are one shingle; very long texts are read whole, and their sets stand in one row. Ties
between copies go to the smallest ``doc_id``. Rows that share a ``doc_id`` count as one document with several texts; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, own, read, slices, without

SKETCH, WIDTH, ROUNDS = 128, 3, 2
COORDINATES = SKETCH // WIDTH
#: Up to so many ids (8 bytes each) are broadcast to pick the texts to read again; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Lists with more nodes outside the largest component are split by set size before blocks are made.
SHORT = 128
#: Nodes and shingles of a block, about.
BLOCK_NODES, BLOCK_SHINGLES = 2048, 500_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20)
_ODD_32 = _rng.integers(0, 2**31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SALT_32 = _rng.integers(0, 2**32, SKETCH, dtype=np.uint32)


def least_matches(places: int, chance: float, miss: float = 1e-6) -> int:
    """The largest number of agreeing places that fewer than ``miss`` of all links at this chance of agreement fall short of."""
    total, m = 0.0, 0
    while (total := total + math.comb(places, m) * chance**m * (1 - chance) ** (places - m)) < miss:
        m += 1
    return max(1, m)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's ``n``-word shingles; of all its words if they are fewer."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(n, len(hashed))
    key = np.full(len(hashed) - size + 1, size, np.uint64)
    for k in range(size):
        key = _mix(key * _STEP + hashed[k : len(key) + k])
    return np.unique(key)


def minima(keys: np.ndarray) -> np.ndarray:
    """``SKETCH`` minimum hashes of a set."""
    out, short = np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32), (keys >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 1024):
        out = np.minimum(out, ((short[None, i : i + 1024] ^ _SALT_32[:, None]) * _ODD_32[:, None]).min(axis=1))
    return out.astype(np.uint64)


def signature(low: np.ndarray) -> np.ndarray:
    """Coordinates of ``WIDTH`` minimum hashes each, hashed with their place."""
    key = np.arange(COORDINATES, dtype=np.uint64)
    for part in low[: COORDINATES * WIDTH].reshape(COORDINATES, WIDTH).T:
        key = _mix(key * _STEP + part + np.uint64(1))
    return key


def sketch(low: np.ndarray) -> np.ndarray:
    """Four bits of each minimum hash, sixteen to a number."""
    bits = (_mix(low + _STEP) & np.uint64(15)).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(bits, axis=1)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, hashed coordinates, sketch)."""

    def lists(rows: list[np.ndarray], width: int):
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(np.array(rows, np.uint64).view(np.int64).ravel()))

    def sign(batches):
        for batch in slices(batches, 1):
            sizes, digests, coords, sketches = [], [], [], []
            for text in batch.column(1).cast("binary").to_pylist():
                keys = shingles(text, n)
                sizes.append(len(keys))
                digests.append(hashlib.blake2b(keys.tobytes(), digest_size=16).digest())
                low = minima(keys)
                coords.append(signature(low))
                sketches.append(sketch(low))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists(coords, COORDINATES), lists(sketches, SKETCH // 16)], ["doc_id", "n_shingles", "digest", "coords", "sketch"])

    return own(docs, "doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, digest binary, coords array<long>, sketch array<long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def collect(batches):
        for batch in slices(batches, 1):
            sets = [shingles(t, n) for t in batch.column(1).cast("binary").to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["id", "items"])

    return docs.mapInArrow(collect, "id long, items array<long>")


def chosen_sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, items) of the texts of ``ids``, a written table."""
    ids = ids.select(F.col("id").alias("doc_id"))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return _sets(docs.join(ids, "doc_id", "left_semi").select("doc_id", "text"), n)


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every linked node; the component is its smallest node. Alternating star contraction."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    while True:
        both = edges.union(edges.select("b", "a"))
        lows = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lows, "a").where("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lows, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(small.union(lows.select("a", F.col("m").alias("b"))).distinct())
        # done when every node but a root points at one root
        roots = edges.select("b").distinct().withColumn("root", F.lit(True))
        open_ends = edges.groupBy("a").agg(F.count("*").alias("n")).join(roots.withColumnRenamed("b", "a"), "a", "left").where("n > 1 or root")
        if open_ends.isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def agreement(a: str, b: str):
    """Places on which two sketches agree."""
    same = F.lit(0)
    for i in range(SKETCH // 16):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        same = same + 16 - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return same


def _groups(batches, width: int):
    """Row groups with equal first ``width`` columns from a stream that is sorted by them."""
    carried = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*carried, batch]).combine_chunks()
        keys = np.stack([table.column(i).to_numpy() for i in range(width)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]
        for x, y in zip(cuts, cuts[1:], strict=False):
            yield table.slice(x, y - x)
        carried = table.slice(cuts[-1]).to_batches()
    if carried:
        yield pa.Table.from_batches(carried)


def _sides(group) -> tuple:
    """Ids, components, flags and flat values of the strays' block and of the block they are compared with."""
    ids, components, stray, left = (group.column(c).to_numpy(zero_copy_only=False) for c in ("id", "component", "stray", "left"))
    lists = group.column("items").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    values, bounds = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    return ids, components, stray, np.flatnonzero(left), np.flatnonzero(~left), values, bounds


def _may_meet(ids, components, stray, i: int, others: np.ndarray) -> np.ndarray:
    return (components[others] != components[i]) & ((ids[i] < ids[others]) | ~stray[others])


BLOCK = ("key", "x", "y")
_ROWS = "key long, x int, y int, id long, component long, stray boolean, left boolean"


def blocks(rows: DataFrame) -> DataFrame:
    """Rows (key, id, component, stray, n_shingles) in pairs of blocks: (key, x, y, ..., left)."""
    size = lambda only: F.ceil(F.greatest(F.sum(F.when(only, 1)) / BLOCK_NODES, F.sum(F.when(only, F.col("n_shingles"))) / BLOCK_SHINGLES)).cast("int")
    cut = rows.groupBy("key").agg(size(F.col("stray")).alias("nx"), size(F.lit(True)).alias("ny"))
    cut = rows.join(cut, "key").withColumn("h", F.xxhash64("id", F.lit(1)))
    left = cut.where("stray").select("key", F.pmod("h", "nx").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("y"), "id", "component", "stray", F.lit(True).alias("left"))
    right = cut.select("key", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("x"), F.pmod("h", "ny").cast("int").alias("y"), "id", "component", "stray", F.lit(False).alias("left"))
    return left.union(right)


def partnered(rows: DataFrame, agreed: int) -> DataFrame:
    """The rows of blocks, ``items`` their sketches, that have a partner in the other block."""

    def run(batches):
        low = np.uint64(0x1111111111111111)
        for group in _groups(batches, 3):
            ids, components, stray, left, right, values, _ = _sides(group)
            sketches, hit = values.reshape(len(ids), -1), np.zeros(len(ids), bool)
            for i in left.tolist():
                x = sketches[right] ^ sketches[i]
                x |= x >> np.uint64(1)
                x |= x >> np.uint64(2)
                near = (SKETCH - np.bitwise_count(x & low).sum(axis=1, dtype=np.int64) >= agreed) & _may_meet(ids, components, stray, i, right)
                if near.any():
                    hit[i] = True
                    hit[right[near]] = True
            if hit.any():
                yield from group.drop_columns("items").take(pa.array(np.flatnonzero(hit))).to_batches()

    return rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(run, _ROWS)


def linked(rows: DataFrame, part: int, whole: int) -> DataFrame:
    """Links (a, b) in blocks, ``items`` their sets: one for each stray and component of the other block."""

    def run(batches):
        for group in _groups(batches, 3):
            ids, components, stray, left, right, values, bounds = _sides(group)
            _, codes = np.unique(values, return_inverse=True)
            sizes, found = np.diff(bounds), []
            if not len(left) or not len(right):
                continue
            flat = np.concatenate([codes[bounds[k] : bounds[k + 1]] for k in right.tolist()])
            starts = np.concatenate([[0], np.cumsum(sizes[right])[:-1]])
            member = np.zeros(len(codes) + 1, np.int32)
            for i in left.tolist():
                own_codes = codes[bounds[i] : bounds[i + 1]]
                member[own_codes] = 1
                both = np.add.reduceat(member[flat], starts)
                member[own_codes] = 0
                near = (whole * both.astype(np.int64) >= part * (sizes[i] + sizes[right] - both)) & _may_meet(ids, components, stray, i, right)
                if near.any():
                    _, firsts = np.unique(components[right[near]], return_index=True)
                    found += [(int(ids[i]), int(ids[k])) for k in right[near][firsts].tolist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(run, "a long, b long")


class _Linker:
    """Confirmed links and the components they give, as they grow."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, similarity: tuple[int, int]):
        self.nodes, self.sets, self.part, self.whole = nodes, sets, *similarity
        self.agreed = least_matches(SKETCH, self.part / self.whole + (1 - self.part / self.whole) / 16)
        self.found = materialise(nodes.select("id", F.col("id").alias("component")).limit(0))

    def near(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b) whose sizes and sketches allow a link."""
        a, b = (self.nodes.select(*(F.col(c).alias(f"{c}_{s}") for c in ("id", "n_shingles", "sketch"))) for s in "ab")
        near = pairs.join(a, F.col("a") == F.col("id_a")).join(b, F.col("b") == F.col("id_b"))
        near = near.where(F.expr(f"{self.whole} * least(n_shingles_a, n_shingles_b) >= {self.part} * greatest(n_shingles_a, n_shingles_b)"))
        return near.where(agreement("sketch_a", "sketch_b") >= self.agreed).select("a", "b")

    def confirm(self, near: DataFrame) -> None:
        """Checks pairs (a, b) on the full sets."""
        a, b = (self.sets.select(F.col("id").alias(f"id_{s}"), F.col("items").alias(f"items_{s}")) for s in "ab")
        near = near.distinct().join(b, F.col("b") == F.col("id_b")).join(a, F.col("a") == F.col("id_a"))
        near = near.withColumn("both", F.size(F.array_intersect("items_a", "items_b")))
        self.take(near.where(F.expr(f"{self.whole} * both >= {self.part} * (size(items_a) + size(items_b) - both)")).select("a", "b"))

    def take(self, links: DataFrame) -> None:
        links = materialise(links)
        if not links.isEmpty():
            self.found = components(links.union(self.found.select(F.col("id").alias("a"), F.col("component").alias("b"))))

    def meet(self, rows: DataFrame) -> None:
        """Links between the strays of lists (key, id, component, stray) and the other components there."""
        nodes = self.nodes.select("id", "n_shingles")
        cut = blocks(rows.join(nodes, "id").select("key", "id", "component", "stray", "n_shingles"))
        near = materialise(partnered(cut.join(self.nodes.select("id", F.col("sketch").alias("items")), "id").select(*cut.columns, "items"), self.agreed))
        self.take(linked(near.join(self.sets, "id").select(*near.columns, "items"), self.part, self.whole))

    def named(self, posted: DataFrame) -> DataFrame:
        return posted.join(self.found, "id", "left").withColumn("component", F.coalesce("component", "id"))

    def round(self, posted: DataFrame, turn: int) -> DataFrame:
        """Links every list's nodes to its hub. Gives the lists (key, id) that held several components before that."""
        named = self.named(posted)
        first = F.struct(F.xxhash64("id", "key", F.lit(turn)) if turn else F.col("id"), "id")
        hubs = named.groupBy("key").agg(F.min_by(F.struct("id", "component"), first).alias("hub"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        mixed = materialise(named.join(hubs.select("key", "hub"), "key"))
        pairs = mixed.where("component <> hub.component").select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()
        self.confirm(self.near(pairs))
        return mixed.select("key", "id")

    def lists(self, posted: DataFrame) -> DataFrame:
        """Lists that hold several components: a node is a stray unless it is in the list's largest."""
        named = self.named(posted)
        parts = named.groupBy("key", "component").agg(F.count("*").alias("n"))
        mixed = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n")).where("most < n")
        return named.join(mixed.select("key", "main", (F.col("n") - F.col("most")).alias("strays")), "key").select("key", "id", "component", (F.col("component") != F.col("main")).alias("stray"), "strays")


def link(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; linked at part / whole or more of Jaccard similarity."""
    docs = own(docs, "doc_id", "text")
    signed = materialise(signatures(docs, n))
    full = F.expr("n_shingles > 0 and doc_id is not null")
    filled = signed.where(full)
    # the smallest document of each set, with what is known of it: copies are counted off before the shuffle
    groups = materialise(filled.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "coords", "sketch")).alias("node")))
    nodes = groups.select(F.col("node.doc_id").alias("id"), "node.n_shingles", "node.coords", "node.sketch")
    groups = groups.select("digest", F.col("node.doc_id").alias("node"))

    # Coordinates that collide at all, rare ones first; nodes that collide on too few of them have no link.
    matches = least_matches(COORDINATES, (similarity[0] / similarity[1]) ** WIDTH)
    posted = nodes.select("id", F.explode("coords").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    order = posted.join(shared, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys")).where(F.size("keys") >= matches)
    order = materialise(order.select("id", F.transform("keys", lambda k: k["key"]).alias("keys")))
    lists = order.select("id", F.explode(F.slice("keys", F.lit(1), F.size("keys") - matches + 1)).alias("key"))
    linker = _Linker(materialise(nodes.join(order.select("id"), "id", "left_semi").select("id", "n_shingles", "sketch")), materialise(chosen_sets(docs, order.select("id"), n)), similarity)
    for turn in range(ROUNDS):
        lists = linker.round(lists, turn)

    mixed = materialise(linker.lists(lists))
    # linked sets differ in size by less than one class, so they meet in the larger one's class
    step = math.log(similarity[1] / similarity[0])
    sizes = nodes.select("id", F.floor(F.log("n_shingles") / step + 1e-9).alias("class"))
    sized = mixed.where(f"strays > {SHORT}").select("key", "id").join(sizes.select("id", "class"), "id")
    sized = sized.select("id", F.explode(F.array(F.xxhash64("key", "class"), F.xxhash64("key", F.col("class") + 1))).alias("key"))
    linker.meet(mixed.where(f"strays <= {SHORT}").union(linker.lists(sized).select(*mixed.columns)))

    roots = groups.join(linker.found, F.col("node") == F.col("id"), "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    named = filled.select("doc_id", "n_shingles", "digest").join(roots, "digest", "left").select("doc_id", "n_shingles", "component_id")
    # empty sets share a digest, and would all meet in one task
    alone = signed.where(~full).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """The kept documents with all their columns."""
    return without(docs, link(docs, n, similarity).where("not kept").select("doc_id").distinct())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "documents"), n=2)
