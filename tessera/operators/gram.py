"""Weighted cross products: all that a pass over the rows sends to the driver.

Few columns are summed by one aggregate in generated code; wide designs go through numpy in Arrow batches, and their
partial sums are added by a second aggregate, so the driver gets one row for each pair of columns either way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.families import ARRAYS, Family, ModelError

NARROW = 10


def cross(df: DataFrame, xs: list[Column], weights: list[Column], scores: list[Column], extras: list[Column] = ()) -> tuple[list[np.ndarray], list[np.ndarray], list[float]]:
    """For a design of ones and ``xs``: X'WX for each weight, X's for each score, and sums of ``extras``."""
    d = len(xs) + 1
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    if d <= NARROW:
        named = df.select(*[x.alias(f"_x{i + 1}") for i, x in enumerate(xs)], *[w.alias(f"_w{k}") for k, w in enumerate(weights)], *[s.alias(f"_s{k}") for k, s in enumerate(scores)], *[e.alias(f"_e{k}") for k, e in enumerate(extras)])
        x = lambda i: F.col(f"_x{i}") if i else F.lit(1.0)
        sums = [F.sum(F.col(f"_w{k}") * x(i) * x(j)) for k in range(len(weights)) for i, j in upper]
        sums += [F.sum(F.col(f"_s{k}") * x(i)) for k in range(len(scores)) for i in range(d)]
        sums += [F.sum(f"_e{k}") for k in range(len(extras))]
        row = np.array([0.0 if v is None else float(v) for v in named.agg(*sums).first()])
    else:
        parts = [F.array(F.lit(1.0), *xs), F.array(*weights, F.lit(0.0)), F.array(*scores, F.lit(0.0)), F.array(*extras, F.lit(0.0))]
        named = df.select(*[p.alias(n) for p, n in zip(parts, "xwse", strict=True)])
        n_w, n_s, n_e = len(weights), len(scores), len(extras)

        def partial(batches):
            total = np.zeros(n_w * len(upper) + n_s * d + n_e)
            rows, cols = np.array(upper).T
            for batch in batches:
                x, w, s, e = (np.asarray(c.flatten(), float).reshape(batch.num_rows, -1) for c in batch.columns)
                grams = [(x.T @ (x * w[:, [k]]))[rows, cols] for k in range(n_w)]
                total += np.concatenate([*grams, *(x.T @ s[:, k] for k in range(n_s)), e[:, :n_e].sum(0)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "part"])

        found = named.mapInArrow(partial, "place int, part double").groupBy("place").agg(F.sum("part").alias("v")).collect()
        row = np.zeros(n_w * len(upper) + n_s * d + n_e)
        for r in found:
            row[r["place"]] = r["v"]
    grams, at = [], 0
    for _ in weights:
        g = np.zeros((d, d))
        for (i, j), v in zip(upper, row[at : at + len(upper)], strict=True):
            g[i, j] = g[j, i] = v
        grams.append(g)
        at += len(upper)
    rights = [row[at + k * d : at + (k + 1) * d] for k in range(len(scores))]
    return grams, rights, list(row[at + len(scores) * d :])


def blocks(df: DataFrame, columns: list[Column], complete: bool = True) -> RDD:
    """The columns as doubles, one block of bytes for each Arrow batch: steps by the hundred read them without planning.
    Unless ``complete``, rows with a NULL are left out."""
    width = len(columns)

    def packed(batches):
        for batch in batches:
            v = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            raw = (v if complete else v[~np.isnan(v).any(1)]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary()), pa.array([width], pa.int32())], ["raw", "width"])

    return df.select(F.array(*columns).alias("x")).mapInArrow(packed, "raw binary, width int").rdd.map(tuple)


#: Bytes of rows that a task of a pass reads, at least.
TASK_BYTES = 32 << 20


def gathered(rows: RDD, numbers: float) -> RDD:
    """Blocks that hold so many ``numbers`` in no more partitions than their bytes need: passes by the hundred over small
    data would mostly start tasks."""
    needed = max(1, int(numbers * 8) // TASK_BYTES)
    return rows.coalesce(needed) if needed < rows.getNumPartitions() else rows


def added(parts: RDD) -> tuple[np.ndarray, np.ndarray]:
    """Sums and largest values of (sums, peaks), one for each partition; through a tree where there are many."""
    join = lambda p, q: (p[0] + q[0], np.maximum(p[1], q[1]))
    return parts.reduce(join) if parts.getNumPartitions() <= 64 else parts.treeReduce(join)


def opened(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(-1, width)


def summed(rows: RDD | list, part, highest: bool = False, read=opened) -> list[np.ndarray]:
    """The sums of the arrays that ``part(block)`` gives for each block of rows, added up through a tree. With ``highest``
    the last array's largest values are kept instead. Without any row there is nothing to sum: an error."""
    adds = lambda a, b: [p + q for p, q in zip(a, b, strict=True)]
    both = (lambda a, b: [*adds(a[:-1], b[:-1]), np.maximum(a[-1], b[-1])]) if highest else adds
    join = lambda a, b: b if a is None else a if b is None else both(a, b)

    def partial(found):
        total = None
        for raw, width in found:
            block = read(raw, width)
            if len(block):
                total = join(total, part(block))
        yield total

    if isinstance(rows, list):
        found = next(partial(rows))
    elif parts := rows.getNumPartitions():
        sums = rows.mapPartitions(partial)
        found = sums.reduce(join) if parts <= 64 else sums.treeReduce(join)
    else:
        found = None
    if found is None:
        raise ModelError("no complete rows (every row has a NULL)")
    return found


def steps_over(rows: RDD, run):
    """``run(rows)``, a loop of passes over blocks. Where they all lie in one partition, its task runs the whole loop."""
    if rows.getNumPartitions() > 1:
        return run(rows)
    return rows.mapPartitions(lambda found: [run(list(found))]).collect()[0]


def gradient(rows: RDD | list, fam: Family, beta: np.ndarray) -> tuple[np.ndarray, float]:
    """X's of the weighted score and the largest observed weight, over blocks of (y, offset, weight, x..)."""

    def part(block):
        y, offset, a = block.T[:3]
        x = np.hstack([np.ones((len(y), 1)), block[:, 3:]])
        mu = fam.mean(offset + x @ beta, ARRAYS)
        return [x.T @ (a * fam.score(y, mu, ARRAYS)), np.array(fam.observed(y, mu, ARRAYS).max() if fam.log_link else -np.inf)]

    right, peak = summed(rows, part, highest=True)
    return right, float(peak)


def triangle(rows: RDD) -> np.ndarray:
    """The triangular factor of the rows, given as blocks (weight, columns..): every partition reduces to one, and two are
    merged by factoring one above the other. It keeps the digits that squares lose."""

    def partial(found):
        r = None
        for raw, width in found:
            block = np.frombuffer(raw).reshape(-1, width)
            v = np.sqrt(block[:, :1]) * block[:, 1:]
            if len(v):
                r = np.linalg.qr(v if r is None else np.vstack([r, v]), mode="r")
        if r is not None:
            yield r

    join = lambda p, q: np.linalg.qr(np.vstack([p, q]), mode="r")
    parts = rows.mapPartitions(partial)
    return parts.reduce(join) if parts.getNumPartitions() <= 64 else parts.treeReduce(join)


#: Below this ratio of its smallest to its largest singular value a factor counts as singular.
SINGULAR = 1e-11


def root_inverse(r: np.ndarray) -> np.ndarray | None:
    """The inverse of r'r for a triangular factor r, with its columns scaled to one length, or None."""
    scale = np.sqrt((r * r).sum(0))
    if not np.all(np.isfinite(r)) or np.any(~(scale > 0)):
        return None
    u, s, v = np.linalg.svd(r / scale)
    if s[-1] < SINGULAR * s[0]:
        return None
    back = v.T / s
    return back @ back.T / np.outer(scale, scale)


def inverse(a: np.ndarray, limit: float = 1e-12) -> np.ndarray | None:
    """Inverse through the unit-diagonal form, or None where a pivot of it falls below ``limit``."""
    scale = np.sqrt(np.diag(a))
    if not np.all(np.isfinite(a)) or np.any(~(scale > 0)):
        return None
    work = np.hstack([a / np.outer(scale, scale), np.eye(len(a))])
    n = len(a)
    for k in range(n):
        p = k + int(np.argmax(np.abs(work[k:, k])))
        if abs(work[p, k]) < limit:
            return None
        work[[k, p]] = work[[p, k]]
        work[k] /= work[k, k]
        others = np.arange(n) != k
        work[others] -= np.outer(work[others, k], work[k])
    return work[:, n:] / np.outer(scale, scale)


def descend(a: np.ndarray, b: np.ndarray, threshold: float, start: np.ndarray, sweeps: int = 100) -> np.ndarray:
    """Coordinate descent for beta'A beta / 2 - b'beta + threshold * sum |beta_j|; the first coefficient is free."""
    beta = start.copy()
    for _ in range(sweeps):
        before = beta.copy()
        for j in range(len(b)):
            if a[j, j] <= 0:
                beta[j] = 0.0
                continue
            r = b[j] - a[j] @ beta + a[j, j] * beta[j]
            cut = threshold if j else 0.0
            beta[j] = np.sign(r) * max(abs(r) - cut, 0.0) / a[j, j]
        if np.max(np.abs(beta - before)) < 1e-14:
            break
    return beta
