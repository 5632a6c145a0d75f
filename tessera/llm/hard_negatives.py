"""Hard negatives by inner products in an orthogonally rotated space.

Components become integers, floor(256 * x), and a score is an integer inner product. The eigenvectors of the vectors' second
moments (one aggregation; a matrix of the number of components) rotate all vectors, so that leading components hold as much
of the products as they can. For a pair, the partial product over the leading components and the product of the norms of the
two remainders bound the score from both sides; a slack covers the rounding of the rotation. A pair goes on to more
components, and at last to the integer product of the vectors themselves, only while its bounds leave it a chance: against
the last place held so far and, for negatives, against the band that the anchor's positives allow.

Anchors are the stated query set, compared with all rows in blocks: rows are dealt to groups, anchors to blocks, and a cell
(block of anchors, group of rows) is worked off by one task that holds the anchors of the block and streams the rows. Groups
are dealt by hash, whatever the label, so that a frequent label is no larger task than others. A cell returns its best rows
for each anchor, and the best of all cells are ranked in a second step.

Rows with a null id, label, vector or component, or with a component that is not finite, take no part, nor do those with a
component of 2 ** 18 or more, whose scores would not fit the result's integers (up to 2000 components). Shorter vectors are
filled up with zeros. Rows with the same ``vec_id`` are rows of their own: each may be an anchor, and the others may be its
positives; between them the order of ties is open. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, own, parallelism, read

SCALE = 256
LARGEST = 1 << 18
#: Anchors held by a task, and rows that stream past them, about.
ANCHORS_TOGETHER, ROWS_TOGETHER = 10_000, 1_000_000
#: Pairs that a task looks at together; a pair that survives a stage takes some 50 numbers meanwhile.
PAIRS_TOGETHER = 1 << 18
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, v): the rows that take part, their components as integers. Written once: ``row`` numbers them."""
    rows = own(vectors, "vec_id", "embedding", "label").where("vec_id is not null and label is not null and embedding is not null")
    x = F.transform("embedding", lambda c: c.cast("double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    # comparisons with null are null, and NaN is above all numbers
    rows = rows.where(F.forall("x", lambda c: F.coalesce(F.abs(c) < float(LARGEST), F.lit(False))))
    return materialise(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform("x", lambda c: F.floor(c * SCALE).cast("int")).alias("v")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer rows of ``width`` components, shorter ones filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors of the second moments as columns, the largest first. Only width x width sums reach the driver."""

    def partial(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column(0), width).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width, dtype=np.int32)), pa.array(total.ravel())], ["place", "part"])

    sums = np.zeros(width * width)
    for r in rows.select("v").mapInArrow(partial, "place int, part double").groupBy("place").agg(F.sum("part").alias("s")).collect():
        sums[r["place"]] = r["s"]
    return np.linalg.eigh(sums.reshape(width, width))[1][:, ::-1].copy()


class Best:
    """The first ``k`` rows of each slot by score, then id. New rows wait until there are enough of them to sort."""

    def __init__(self, slots: int, k: int):
        self.k, self.slots = k, slots
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.waiting, self.n = [], 0
        self.last = np.full(slots, -np.inf)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.waiting.append((slot, score, ids))
        self.n += len(slot)
        if self.n > max(4096, len(self.slot) // 2):
            self.settle()

    def settle(self) -> None:
        slot, score, ids = (np.concatenate(x) for x in zip((self.slot, self.score, self.id), *self.waiting, strict=True))
        self.waiting, self.n = [], 0
        order = np.lexsort((ids, -score, slot))
        slot = slot[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = place < self.k
        order = order[kept]
        self.slot, self.score, self.id = slot[kept], score[order], ids[order]
        full = place[kept] == self.k - 1
        self.last[self.slot[full]] = self.score[full]


class Anchors:
    """The anchors of a block, rotated, with what their pairs have to reach."""

    def __init__(self, turn: np.ndarray, stages: list[int]):
        self.turn, self.stages, self.parts = turn, stages, []

    def rotated(self, v: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Rotated vectors, the norms of what each stage leaves out, and the whole norms."""
        y = v @ self.turn
        squares = np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1]
        rest = [np.sqrt(squares[:, m]) if m < v.shape[1] else np.zeros(len(v)) for m in self.stages]
        return y, rest, np.sqrt(squares[:, 0]) if v.shape[1] else np.zeros(len(v))

    def close(self) -> None:
        self.row, self.label, self.v = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.y, self.rest, self.norm = self.rotated(self.v.astype(float))


def surviving(anchors: Anchors, v: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row, anchor) whose score lies between ``low`` and ``high`` of the anchor, with their integer scores.
    ``allowed``: rows x anchors."""
    y, rest, norm = anchors.rotated(v.astype(float))
    slack = 64 * (v.shape[1] + 1) * np.finfo(float).eps
    first = anchors.stages[0]
    part = y[:, :first] @ anchors.y[:, :first].T
    reach = rest[0][:, None] * anchors.rest[0] + slack * norm[:, None] * anchors.norm + 1e-6
    at, to = np.nonzero(allowed & (part + reach >= low) & (part - reach <= high))
    part = part[at, to]
    for stage in range(1, len(anchors.stages)):
        a, b = anchors.stages[stage - 1 : stage + 1]
        part = part + np.einsum("ij,ij->i", y[at, a:b], anchors.y[to, a:b])
        reach = rest[stage][at] * anchors.rest[stage][to] + slack * norm[at] * anchors.norm[to] + 1e-6
        kept = (part + reach >= low[to]) & (part - reach <= high[to])
        at, to, part = at[kept], to[kept], part[kept]
    score = np.einsum("ij,ij->i", v[at], anchors.v[to])
    kept = (score >= low[to]) & (score <= high[to])
    return at[kept], to[kept], score[kept]


def _stages(width: int) -> list[int]:
    return sorted({max(1, width // 4), max(1, width // 2), max(1, 3 * width // 4)})


def _cells(rows: DataFrame, anchors: DataFrame, blocks: int, groups: int, extra: list[str]) -> DataFrame:
    """Rows and anchors dealt to cells, the anchors of a cell before its rows; (cell, side, row, vec_id, label, v, extra..).
    Each row goes to every block of anchors, each anchor to every group of rows."""
    block = F.pmod(F.xxhash64(F.col("row"), F.lit(1)), F.lit(blocks))
    group = F.pmod(F.xxhash64(F.col("row"), F.lit(2)), F.lit(groups))
    fields = ["row", "vec_id", "label", "v"]
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_g"), block.alias("_b"), F.lit(0).alias("side"), *fields, *extra)
    given = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"), group.alias("_g"), F.lit(1).alias("side"), *fields, *[F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra])
    both = asked.unionByName(given).withColumn("cell", (F.col("_b") * groups + F.col("_g")).cast("long")).drop("_b", "_g")
    return both.repartitionById(blocks * groups, F.col("cell").cast("int")).sortWithinPartitions("cell", "side").select("cell", "side", *fields, *extra)


def _streamed(batches, turn: np.ndarray, prepare, meet, finish):
    """Runs through sorted cells: anchors are gathered, then rows pass in slices; yields what ``finish`` makes of a cell."""
    width, cell, anchors, state, extra = len(turn), None, None, None, []
    for batch in batches:
        cells, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if a == b:
                continue
            if cells[a] != cell:
                if state is not None:
                    yield from finish(anchors, state)
                cell, anchors, state, extra = cells[a], Anchors(turn, _stages(width)), None, []
            piece = batch.slice(a, b - a)
            row, ids, label = (piece.column(i).to_numpy() for i in (2, 3, 4))
            v = matrix(piece.column(5), width)
            if sides[a] == 0:
                anchors.parts.append((row, label, v))
                extra += piece.column(6).to_pylist() if piece.num_columns > 6 else []
                continue
            if state is None:
                if not anchors.parts:
                    continue  # a cell without anchors
                anchors.close()
                state = prepare(anchors, extra)
            step = max(1, PAIRS_TOGETHER // len(anchors.row))
            for i in range(0, len(row), step):  # a slice's survivors and their components are held at once
                meet(anchors, state, row[i : i + step], ids[i : i + step], label[i : i + step], v[i : i + step])
    if state is not None:
        yield from finish(anchors, state)


def _ranked(found: DataFrame, by: list[str], score: str, name: str, k: int) -> DataFrame:
    """The first ``k`` of each slot over all cells."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), name)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def positives_of(rows: DataFrame, anchors: DataFrame, turn: np.ndarray, k: int, blocks: int, groups: int) -> DataFrame:
    """(row, positives): for each anchor row its first ``k`` other rows of the same label, as array<struct<id, score>>."""

    def prepare(own_anchors, _):
        return Best(len(own_anchors.row), k)

    def meet(own_anchors, best, row, ids, label, v):
        allowed = (label[:, None] == own_anchors.label) & (row[:, None] != own_anchors.row)
        at, to, score = surviving(own_anchors, v, allowed, best.last, np.full(best.slots, np.inf))
        best.add(to, score, ids[at])

    def finish(own_anchors, best):
        best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(own_anchors.row[best.slot]), pa.array(best.id), pa.array(best.score)], ["row", "id", "score"])

    cells = _cells(rows, anchors, blocks, groups, [])
    found = cells.mapInArrow(lambda batches: _streamed(batches, turn, prepare, meet, finish), "row long, id long, score long")
    best = _ranked(found, ["row"], "score", "id", k)
    return best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))  # k at most


def negatives_of(rows: DataFrame, anchors: DataFrame, turn: np.ndarray, k: int, low: int, high: int, blocks: int, groups: int) -> DataFrame:
    """(row, place, id, score): for each anchor row and place of a positive the first ``k`` rows of another label whose
    score is between ``low`` and ``high`` hundredths of the positive's. ``anchors`` have ``positives``."""

    def prepare(own_anchors, extra):
        most = max(len(p) for p in extra)
        floors, ceilings = (np.full((len(extra), most), x) for x in (np.inf, -np.inf))
        for i, found in enumerate(extra):
            for j, p in enumerate(found):
                floors[i, j], ceilings[i, j] = -(-low * p["score"] // 100), high * p["score"] // 100
        return Best(len(extra) * most, k), floors, ceilings

    def meet(own_anchors, state, row, ids, label, v):
        best, floors, ceilings = state
        need = np.maximum(floors, best.last.reshape(floors.shape))
        need = np.where(need <= ceilings, need, np.inf)
        at, to, score = surviving(own_anchors, v, label[:, None] != own_anchors.label, need.min(1), np.where(need < np.inf, ceilings, -np.inf).max(1))
        fits = (score[:, None] >= need[to]) & (score[:, None] <= ceilings[to])
        pair, place = np.nonzero(fits)
        best.add(to[pair] * floors.shape[1] + place, score[pair], ids[at[pair]])

    def finish(own_anchors, state):
        best, floors, _ = state
        best.settle()
        which, place = np.divmod(best.slot, floors.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(own_anchors.row[which]), pa.array(place), pa.array(best.id), pa.array(best.score)], ["row", "place", "id", "score"])

    cells = _cells(rows, anchors, blocks, groups, ["positives"])
    found = cells.mapInArrow(lambda batches: _streamed(batches, turn, prepare, meet, finish), "row long, place long, id long, score long")
    return _ranked(found, ["row", "place"], "score", "id", k)


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, anchors_together: int = ANCHORS_TOGETHER, rows_together: int = ROWS_TOGETHER) -> DataFrame:
    """For each row that ``anchor`` (a condition on vec_id and label) holds for and each of its first ``positives`` rows of
    the same label: the first ``negatives`` rows of another label with a score of ``low`` to ``high`` hundredths of the
    positive's."""
    spark, rows = vectors.sparkSession, usable(vectors)
    totals = rows.agg(F.count("*"), F.max(F.size("v")), F.count(F.when(anchor, 1))).first()
    if not totals[2]:
        return spark.createDataFrame([], MINED)
    width = max(totals[1], 1)
    blocks = -(-totals[2] // anchors_together)
    groups = max(-(-totals[0] // rows_together), -(-parallelism(spark) // blocks))
    turn, anchors = rotation(rows, width), rows.where(anchor)
    chosen = materialise(anchors.join(positives_of(rows, anchors, turn, positives, blocks, groups), "row"))
    found = negatives_of(rows, chosen, turn, negatives, low, high, blocks, groups)
    named = chosen.select("row", F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("place", "p"))
    return found.join(named, ["row", "place"]).select(
        "anchor_id", F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLE = f"""with v as (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x) or abs(x) >= {LARGEST})) = 0),
s as (select a.r as ar, b.r as br, a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
  from v a join v b on a.r <> b.r where a.vec_id % 100 = 0),
p as (select * from s where same qualify row_number() over (partition by ar order by score desc, id) <= 5),
n as (select p.anchor_id, p.id as positive_id, row_number() over (partition by p.ar, p.br order by s.score desc, s.id) as rank, s.id as negative_id, p.score as positive_score, s.score as negative_score
  from p join s on p.ar = s.ar and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10"""
