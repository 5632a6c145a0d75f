"""Fits without a matrix of all pairs of features: wide tables, and string columns with any number of levels.

A row is kept as its dense values (of a block of rows in which most are 0, only the others) and, for each string column, the
place of its level among the features (-1 for the lowest level, which has none). Standardization is folded into the coefficients, so that a dummy column costs one addition a row
and one counter in a pass, however many levels there are. Newton steps come from conjugate gradients: the driver holds
vectors as long as the coefficients.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.families import ARRAYS, Family, ModelError
from tessera.operators.gram import gathered, steps_over, summed
from tessera.operators.names import INTERCEPT, as_double, check_names, check_outcome, quoted, used_columns
from tessera.operators.steps import accelerated, newton_cg
from tessera.sources import free_prefix, table


def text_columns(df: DataFrame, left_out: list[str]) -> list[str]:
    return sorted(f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType)) and f.name not in left_out)


def levels_of(df: DataFrame, names: list[str]) -> dict[str, list[str]]:
    """The levels of each column in string order. They become features, so the driver holds them, as it does the model."""
    if not names:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(quoted(c)).alias("v")) for i, c in enumerate(names)]))
    found: dict[str, list[str]] = {c: [] for c in names}
    for r in df.select(pairs.alias("p")).select("p.c", "p.v").where("v is not null").distinct().collect():
        found[names[r["c"]]].append(r["v"])
    return {c: sorted(vs) for c, vs in found.items()}


def encode_dummies(source: DataFrame | str, outcome: str, *left_out: str | None) -> DataFrame:
    """Treatment contrasts: a 0/1 column for each level of a string column but the lowest; NULL stays NULL."""
    df = table(source)
    levels = levels_of(df, text_columns(df, [outcome, *filter(None, left_out)]))
    kept = [F.col(quoted(c)) for c in df.columns if c not in levels]
    return df.select(*kept, *[(F.col(quoted(c)) == F.lit(v)).cast("int").alias(f"{c}_{v}") for c, vs in levels.items() for v in vs[1:]])


def coded(df: DataFrame, levels: dict[str, list[str]], places: dict[str, int]) -> tuple[DataFrame, list[str]]:
    """``df`` with a column for each column of ``levels``: the place of its level's feature, -1 for the lowest level, NULL
    for NULL. ``places``: the place of a column's second level; the others follow."""
    own, made = free_prefix(df), []
    for i, (c, vs) in enumerate(levels.items()):
        known = pa.table({f"{own}v{i}": pa.array(vs, pa.string()), f"{own}c{i}": pa.array([places[c] + k - 1 if k else -1 for k in range(len(vs))], pa.int32())})
        df = df.join(df.sparkSession.createDataFrame(known), F.col(quoted(c)) == F.col(f"{own}v{i}"), "left").drop(f"{own}v{i}")
        made.append(f"{own}c{i}")
    return df, made


#: A block in which at most this share of the dense values is not 0 keeps only those.
SPARSE = 0.25


def packed(df: DataFrame, columns: list[Column], p: int) -> RDD:
    """The columns as blocks of bytes: three and the places of levels row by row, the ``p`` dense ones in between likewise
    or, where most values are 0, as (row, column, value) of the others, told by a negative width. The columns go to Python
    one by one: an array of a hundred expressions is a method too large for the JVM to compile."""
    width = len(columns)

    def pack(batches):
        for batch in batches:
            v = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            x, around = v[3 : 3 + p], [*v[:3], *v[3 + p :]]
            at = [np.flatnonzero(c) for c in x]
            if sum(map(len, at)) <= SPARSE * batch.num_rows * p:
                row, col = np.concatenate([np.zeros(0, np.int64), *at]), np.repeat(np.arange(p), [len(i) for i in at])
                values = np.concatenate([np.zeros(0), *[c[i] for c, i in zip(x, at, strict=True)]])
                parts = (np.array([batch.num_rows, len(row)]), np.column_stack(around), values, row.astype(np.int32), col.astype(np.int32))
                raw, kind = b"".join(a.tobytes() for a in parts), -width
            else:
                raw, kind = np.column_stack(v).tobytes(), width
            yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary()), pa.array([kind], pa.int32())], ["raw", "width"])

    named = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    return named.mapInArrow(pack, "raw binary, width int").rdd.map(tuple)


class Block:
    """Rows: outcome, offset, weight, places of levels, and products with the dense values."""

    def __init__(self, around: np.ndarray, p: int, x: np.ndarray | None = None, filled: tuple | None = None):
        self.around, self.p, self.x, self.filled = around, p, x, filled
        self.y, self.offset, self.weight, self.at = *around[:, :3].T, around[:, 3:]

    @classmethod
    def read(cls, raw: bytes, width: int, p: int) -> Block:
        if width >= 0:
            v = np.frombuffer(raw).reshape(-1, width)
            return cls(np.hstack([v[:, :3], v[:, 3 + p :]]), p, x=v[:, 3 : 3 + p])
        n, k = np.frombuffer(raw, np.int64, 2).tolist()
        kept = -width - p
        around, values = np.frombuffer(raw, float, n * kept, 16).reshape(n, kept), np.frombuffer(raw, float, k, 16 + 8 * n * kept)
        row, col = np.frombuffer(raw, np.int32, 2 * k, 16 + 8 * n * kept + 8 * k).reshape(2, k)
        return cls(around, p, filled=(row, col, values))

    def __len__(self) -> int:
        return len(self.around)

    def complete(self) -> Block:
        """The rows without NULL and NaN."""
        good = ~np.isnan(self.around).any(1)
        if self.filled is None:
            good &= ~np.isnan(self.x).any(1)
            return Block(self.around[good], self.p, x=self.x[good])
        row, col, values = self.filled
        good[row[np.isnan(values)]] = False
        kept = good[row]
        return Block(self.around[good], self.p, filled=((np.cumsum(good) - 1)[row[kept]], col[kept], values[kept]))

    def known(self) -> np.ndarray:
        """How many values each dense column and each of places has."""
        if self.filled is None:
            dense = (~np.isnan(self.x)).sum(0)
        else:
            dense = len(self) - np.bincount(self.filled[1][np.isnan(self.filled[2])], minlength=self.p)
        return np.append(dense, (~np.isnan(self.at)).sum(0))

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The lowest and the highest values of the dense columns."""
        if self.filled is None:
            return self.x.min(0), self.x.max(0)
        _, col, values = self.filled
        some = np.bincount(col, minlength=self.p) < len(self)
        low, high = np.where(some, 0.0, np.inf), np.where(some, 0.0, -np.inf)
        np.minimum.at(low, col, values)
        np.maximum.at(high, col, values)
        return low, high

    def times(self, slopes: np.ndarray) -> np.ndarray:
        """The dense values times a slope each, summed by row."""
        if self.filled is None:
            return self.x @ slopes
        row, col, values = self.filled
        return np.bincount(row, values * slopes[col], len(self))

    def against(self, r: np.ndarray) -> np.ndarray:
        """The sums of each dense column times ``r``."""
        if self.filled is None:
            return r @ self.x
        row, col, values = self.filled
        return np.bincount(col, values * r[row], self.p)

    def squares(self, center: np.ndarray) -> np.ndarray:
        """Weighted squares of the dense columns' distances to ``center``."""
        if self.filled is None:
            x = self.x - center
            return self.weight @ (x * x)
        row, col, values = self.filled
        far, a = values - center[col], self.weight[row]
        zero = np.where(np.bincount(col, minlength=self.p) < len(self), self.weight.sum() - np.bincount(col, a, self.p), 0.0)
        return np.bincount(col, a * far * far, self.p) + np.maximum(zero, 0.0) * center * center


class WideDesign:
    """Rows as blocks (y, offset, weight, dense values.., places of levels..) and what standardizes them."""

    def __init__(self, source: DataFrame | str, outcome: str, fam: Family, offset_col: str | None = None, weights_col: str | None = None, encode: bool = False):
        df = table(source)
        names = used_columns(df, outcome, offset_col, weights_col)
        texts = text_columns(df, [outcome, offset_col or "", weights_col or ""]) if encode else []
        levels = levels_of(df, texts)
        dense = [c for c in names if c not in texts]
        self.features, places = list(dense), {}
        for c, vs in levels.items():
            places[c] = len(self.features)
            self.features += [f"{c}_{v}" for v in vs[1:]]
        if len(set(self.features)) < len(self.features):
            raise ModelError("a level's column has the name of another column")
        check_names(df, self.features)
        self.p, d = len(dense), len(self.features)
        df, codes = coded(df, levels, places)
        # NULL and NaN are the same in a block
        offset, weight = as_double(df, offset_col) if offset_col else F.lit(0.0), as_double(df, weights_col) if weights_col else F.lit(1.0)
        values = [as_double(df, outcome), offset, weight, *[as_double(df, c) for c in dense], *[F.col(c).cast("double") for c in codes]]
        self.rows = packed(df, values, self.p).persist(StorageLevel.MEMORY_AND_DISK)
        self._count(outcome, fam, dense, texts, len(codes))
        self.few = gathered(self.rows, self.n * len(values))
        center, y_mean, gaps, p = self.mean[: self.p], self.y_mean, self.gaps, self.p

        def squares(block):
            block = block.complete() if gaps else block
            return [np.append(block.squares(center), block.weight @ np.square(block.y - y_mean))]

        spread = np.sqrt(np.maximum(summed(self.few, squares, read=lambda raw, width: Block.read(raw, width, p))[0] / self.total, 0))
        share = self.mean[self.p :]
        sd = np.append(spread[:-1], np.sqrt(np.maximum(share * (1 - share), 0)))
        self.constant |= ~(sd > 0)
        self.sd = np.where(self.constant, 1.0, sd)
        self.y_sd = spread[-1] if spread[-1] >= 1e-300 else 1.0
        if not fam.identity and self.y_mean < 1e-300:
            self.y_mean = 1.0
        self.fam, self.inner = fam, fam.scaled(self.y_mean)
        self.free = np.append(0.0, np.ones(d))
        self.active = np.append(True, ~self.constant)

    def _count(self, outcome: str, fam: Family, dense: list[str], texts: list[str], q: int) -> None:
        """One pass: what the checks need of all rows, and sums, lowest and highest values of the complete ones."""
        p, d = len(dense), len(self.features)

        def partial(found):
            low, high, total = np.full(p + 2, np.inf), np.full(p + 2, -np.inf), np.zeros(6 + p + q + p + 2 * (d - p))
            known, sums, counts = total[6 : 6 + p + q], total[6 + p + q : 6 + p + q + p], total[6 + p + q + p :].reshape(2, d - p)
            for raw, width in found:
                v = Block.read(raw, width, p)
                y = v.y[~np.isnan(v.y)]
                if len(y):
                    low[0], high[0] = min(low[0], y.min()), max(high[0], y.max())
                total[:2] += len(y), ((y != 0) & (y != 1)).sum()
                total[5] += len(v)
                known += v.known()
                v = v.complete()
                if not len(v):
                    continue
                a, at, (least, most) = v.weight, v.at.astype(np.int64), v.ends()
                total[2:5] += len(v), a.sum(), a @ v.y
                low[1:], high[1:] = np.minimum(low[1:], np.append(a.min(), least)), np.maximum(high[1:], np.append(a.max(), most))
                sums += v.against(a)
                for c in at.T:
                    used = c >= 0
                    counts[0] += np.bincount(c[used] - p, minlength=d - p)
                    counts[1] += np.bincount(c[used] - p, a[used], d - p)
            yield low, high, total

        join = lambda s, t: (np.minimum(s[0], t[0]), np.maximum(s[1], t[1]), s[2] + t[2])
        parts = self.rows.mapPartitions(partial)
        low, high, total = (parts.reduce(join) if parts.getNumPartitions() <= 64 else parts.treeReduce(join)) if parts.getNumPartitions() else next(partial([]))
        check_outcome(fam, outcome, total[0], low[0], total[1])
        if not d:
            raise ModelError("no feature columns")
        if empty := [c for c, n in zip([*dense, *texts], total[6 : 6 + p + q], strict=True) if not n]:
            raise ModelError(f"feature column(s) entirely NULL: {', '.join(empty)}")
        if not total[2]:
            raise ModelError("no complete rows (every row has a NULL)")
        if low[1] < 0:
            raise ModelError("weights must be non-negative")
        if not total[3] > 0:
            raise ModelError("weights sum to zero")
        self.n, self.total, self.y_mean = total[2], total[3], total[4] / total[3]
        rest = total[6 + p + q :]
        self.gaps = total[5] > total[2]
        counted, weighted = rest[p : p + d - p], rest[p + d - p :]
        self.constant = np.append(low[2 : 2 + p] == high[2 : 2 + p], (counted == 0) | (counted == total[2]))
        self.mean = np.append(np.where(self.constant[:p], low[2 : 2 + p], rest[:p] / self.total), weighted / self.total)

    def release(self) -> None:
        self.rows.unpersist()

    def _through(self, make, highest: bool = False):
        """Sums over the rows of ``make(y, offset, weight, eta..)``: arrays of one value a row, each times (1, x..), and
        single numbers (their largest, with ``highest``). Takes the coefficients of standardized columns."""
        fam = self.fam
        p, scale, shift = self.p, (self.y_sd if fam.identity else self.y_mean if fam.log_link else 1.0), (self.y_mean if fam.identity else 0.0)
        offset_scale = self.y_sd if fam.identity else 1.0
        mean, sd, d, gaps = self.mean, self.sd, len(self.features), self.gaps

        active = self.active

        def run(rows, *betas: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
            slopes = [np.append(b[1:] / sd, 0.0) for b in betas]
            bases = [b[0] - (s[:-1] * mean).sum() for b, s in zip(betas, slopes, strict=True)]

            def part(block):
                block = block.complete() if gaps else block
                at = block.at.astype(np.int64)
                etas = [base + block.times(s[:p]) + s[at].sum(1) for base, s in zip(bases, slopes, strict=True)]
                vectors, numbers = make((block.y - shift) / scale, block.offset / offset_scale, block.weight, *etas)
                out = []
                for r in vectors:
                    right = np.zeros(d + 1)
                    right[0], right[1 : 1 + p] = r.sum(), block.against(r)
                    for c in at.T:
                        right[1:] += np.bincount(np.where(c < 0, d, c), r, d + 1)[:d]
                    out.append(right)
                return [*out, np.array(numbers, float)]

            *sums, numbers = summed(rows, part, highest, read=lambda raw, width: Block.read(raw, width, p))
            for right in sums:
                right[1:] = (right[1:] - mean * right[0]) / sd * active[1:]
            return sums, numbers

        return run

    def newton(self, l2: float, tol: float, max_iter: int) -> np.ndarray | None:
        fam, total, free = self.inner, self.total, self.free

        def lost(y, o, a, eta):
            mu = fam.mean(eta + o, ARRAYS)
            return [a * fam.score(y, mu, ARRAYS)], [(a * fam.deviance(y, mu, ARRAYS)).sum() / 2]

        def bent(y, o, a, eta, way):
            return [a * fam.information(fam.mean(eta + o, ARRAYS), ARRAYS) * way], [0.0]

        losses, products = self._through(lost), self._through(bent)

        def run(rows):
            def evaluate(beta):
                (right,), (loss,) = losses(rows, beta)
                return loss / total + l2 / 2 * (free * beta) @ beta, -right / total + l2 * free * beta

            def multiply(beta, v):
                return products(rows, beta, v)[0][0] / total + l2 * free * v

            return newton_cg(evaluate, multiply, np.zeros(len(free)), tol, max_iter)

        return steps_over(self.few, run)

    def descent(self, l1: float, l2: float, tol: float, max_iter: int, rate: float | None) -> np.ndarray:
        fam, d = self.inner, len(self.free)

        def steep(y, o, a, eta):
            mu = fam.mean(eta + o, ARRAYS)
            return [a * fam.score(y, mu, ARRAYS)], [fam.observed(y, mu, ARRAYS).max(initial=1.0) if fam.log_link else 1.0]

        slopes = self._through(steep, highest=True)

        step, total, free = rate or (4 / (d + 4 * l2) if fam.name == "logistic" else 1 / (d + l2)), self.total, self.free

        def run(rows):
            def slope(beta):
                (right,), (peak,) = slopes(rows, beta)
                return right / total, peak

            return accelerated(slope, np.zeros(d), step, l1, l2, free, tol, max_iter, restart=True)

        return steps_over(self.few, run)

    def raw(self, beta: np.ndarray) -> dict[str, float]:
        """Coefficients on the columns' own scale, by name."""
        beta = np.where(self.active, beta, 0.0)
        scale = self.y_sd if self.fam.identity else 1.0
        slopes = scale * beta[1:] / self.sd
        base = self.y_mean if self.fam.identity else np.log(self.y_mean) if self.fam.log_link else 0.0
        found = dict(sorted(zip(self.features, (float(b) + 0.0 for b in slopes), strict=True)))
        return {INTERCEPT: float(base + scale * beta[0] - (slopes * self.mean).sum()) + 0.0} | found


def fit_wide(fam: Family, source: DataFrame | str, outcome: str, max_iter: int, rate: float | None, tol: float, l1: float, l2: float, offset_col: str | None, weights_col: str | None, encode: bool, gradient_only: bool) -> dict[str, float]:
    design = WideDesign(source, outcome, fam, offset_col, weights_col, encode)
    try:
        beta = None if gradient_only or l1 > 0 else design.newton(l2, tol, min(max_iter, 200))
        if beta is None:
            beta = design.descent(l1, l2, tol, max_iter, rate)
        return design.raw(beta)
    finally:
        design.release()
