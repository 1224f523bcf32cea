"""Whitened embeddings: leading eigenvectors of their covariance by Jacobi-Davidson.

The covariance is never built.  What the method needs of it are its products with a
few vectors at a time, and each is one pass over the rows: a task multiplies its centred
rows with the block, Spark adds the tasks' sums, and dimensions x block numbers reach the
driver.  There the search space, its Ritz pairs and the locked eigenvectors are kept: a
bounded number of vectors, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, LongType, StructField, StructType

from sparkprof.llm.batches import bounded
from sparkprof.scratch import write_once

SCALE, SHIFT = 1024, 100_000
# Numbers beyond these ends become the ends.
_END = 1 << 60
_LONG = 1 << 63
# Pairs that are sought beside the wanted ones, so that a cluster of values is not cut.
GUARD = 4
# A pair is found when its residual is this small beside the largest eigenvalue.
TOLERANCE = 64 * float(np.finfo(float).eps)
# Residuals that stopped falling count as found below this: rounding of the products holds them there.
STALLED = 1e-12
# MINRES steps for a correction, and the share of the residual at which they end.
INNER_STEPS, INNER_SHARE = 6, 0.05
OUTER_STEPS = 300
# Vectors of the search space at which it is restarted from its best.
SPACE = 6 * (8 + GUARD)
# Numbers of the rows that are multiplied at once.
_CHUNK = 1 << 20
# An eigenvalue this small beside the trace is no direction of its own.
_RANK = 1e-13

Product = Callable[[np.ndarray], np.ndarray]


def quantized(vector: Column) -> Column:
    """floor(SCALE * c) + SHIFT of each number as a long; null if one is null or not finite."""
    values = F.transform(
        vector, lambda c: F.floor(F.greatest(F.lit(-float(_END)), F.least(F.lit(float(_END)), SCALE * c.cast("double")))) + SHIFT
    )
    sound = F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf"))
    )
    return F.when(sound, values)


def whiten(vectors: DataFrame, components: int = 8, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Projects every vector on the leading components of all, each scaled to variance one.

    Every number c of a vector becomes the long floor(1024 * c) + 100000.  Returns for each
    row and component ``id, component`` (from 1, by falling eigenvalue), ``n`` (vectors that
    were fitted), ``deviation`` (the exact sum over dimensions of (n * x - S)^2; null beyond
    a long, then ``deviation_wide`` holds it, up to 38 digits), ``whitened``, ``explained``
    (the share of the variance) and ``identity_error`` (the largest entry of the covariance
    of the whitened rows minus the identity).

    Vectors that are null, empty or hold a null or a non-finite number take no part, nor do
    those of another length than the most frequent one (of two the larger).  Repeated rows
    and null ids stay, each row counts.  A direction without variance is no component, so a
    single vector, copies of one or an empty table give no rows.  Other columns are not read.
    """
    spark, key = vectors.sparkSession, vectors.select(F.col(id)).schema[0].dataType
    rows = vectors.select(F.col(id).alias("id"), quantized(F.col(vector)).alias("x"))
    rows = write_once(rows.filter("x is not null and size(x) > 0"), "quantized")
    # A row per length, of which the first is taken.
    common = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = common["size"] if common else 1
    with bounded(spark):
        fit = Fit.of(rows.filter(F.size("x") == size), size)
        values, directions, trace = fit.components(components)
        scaled = directions / np.sqrt(values)
        error = fit.identity_error(scaled)
        made = StructType([
            StructField("id", key), StructField("deviation", LongType()),
            StructField("deviation_wide", DecimalType(38, 0)), StructField("all", ArrayType(DoubleType())),
        ])
        projected = write_once(fit.rows.mapInArrow(fit.projector(scaled), made), "projected")
    place = F.col("component")
    share = F.element_at(F.array(*[F.lit(float(v / trace)) for v in values], F.lit(None).cast("double")), place)
    return projected.select(
        "id", "deviation", "deviation_wide", F.posexplode("all").alias("place", "whitened")
    ).withColumn("component", (F.col("place") + 1).cast("int")).select(
        F.col("id").alias(id), "component", F.lit(fit.n).cast("long").alias("n"), "deviation", "deviation_wide",
        "whitened", share.alias("explained"), F.lit(error).alias("identity_error"),
    )


@dataclass
class Fit:
    """Rows ``id, x`` of one length, their numbers packed in blocks, how many there are and their exact sums."""

    rows: DataFrame
    blocks: DataFrame
    size: int
    n: int
    sums: list[int]

    @classmethod
    def of(cls, rows: DataFrame, size: int) -> "Fit":
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("x"), size) - SHIFT
                for at in range(0, len(x), step := max(1, _CHUNK // size)):
                    piece = x[at : at + step]
                    wide = int(np.abs(piece).max()) >= 1 << 31
                    data = piece.astype("<i8" if wide else "<i4").tobytes()
                    yield pa.record_batch([pa.array([data], pa.binary()), pa.array([wide])], ["x", "wide"])

        # Every pass reads these blocks as they are, without a conversion per number.
        blocks = write_once(rows.select("x").mapInArrow(pack, "x binary, wide boolean"), "blocks")

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, np.zeros(size, dtype=object)
            for x in _chunks(batches, size):
                n += len(x)
                safe = int(np.abs(x).max(initial=0)) * len(x) < _LONG
                total = total + (x.sum(axis=0).astype(object) if safe else x.astype(object).sum(axis=0))
            if n:
                wide = pa.array([Decimal(v) for v in total], pa.decimal128(38, 0))
                yield pa.record_batch([pa.array(range(size), pa.int32()), wide, pa.array([n] * size, pa.int64())], ["i", "s", "n"])

        parts = blocks.mapInArrow(add, "i int, s decimal(38,0), n long")
        found = parts.groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
        return cls(rows, blocks, size, found[0]["n"] if found else 0, [int(r["s"]) for r in found] or [0] * size)

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        """x - S / n with a single rounding: the whole part of the mean is taken off exactly."""
        whole = np.array([s // max(self.n, 1) for s in self.sums], dtype=np.int64)
        rest = np.array([(s - int(w) * self.n) / max(self.n, 1) for s, w in zip(self.sums, whole)])
        return lambda x: (x - whole).astype(float) - rest

    def total(self, compute: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """Sums ``compute`` of the centred rows over all of them, rows x columns of the given shape."""
        size, centred, names = self.size, self.centred(), [f"c{j}" for j in range(shape[1])]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros(shape), False
            for x in _chunks(batches, size):
                total += compute(centred(x))
                seen = True
            if seen:
                yield pa.record_batch([pa.array(range(shape[0]), pa.int32()), *map(pa.array, total.T.copy())], ["i", *names])

        parts = self.blocks.mapInArrow(add, ", ".join(["i int", *(f"{c} double" for c in names)]))
        found = np.zeros(shape)
        for row in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():
            found[row["i"]] = row[1:]
        return found

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block of vectors."""
        return self.total(lambda c: c.T @ (c @ block), block.shape) / max(self.n, 1)

    def components(self, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Leading eigenvalues, their unit eigenvectors and the trace."""
        trace = float(self.total(lambda c: np.square(c).sum(axis=0)[:, None], (self.size, 1)).sum() / max(self.n, 1))
        if self.n < 2 or trace == 0:
            return np.empty(0), np.empty((self.size, 0)), trace
        values, directions = eigenpairs(self.product, self.size, wanted)
        real = values > _RANK * trace
        return values[real], directions[:, real], trace

    def identity_error(self, scaled: np.ndarray) -> float:
        """How far the covariance of the whitened rows is from the identity."""
        k = scaled.shape[1]
        if not k:
            return 0.0
        mean = self.total(lambda c: (c @ scaled).sum(axis=0)[:, None], (k, 1))[:, 0] / self.n

        def squares(c: np.ndarray) -> np.ndarray:
            y = c @ scaled - mean
            return y.T @ y

        return float(np.abs(self.total(squares, (k, k)) / self.n - np.eye(k)).max())

    def projector(self, scaled: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        size, n, centred = self.size, self.n, self.centred()
        whole = np.array([s // max(n, 1) for s in self.sums], dtype=np.int64)
        rest = np.array([s - int(w) * n for s, w in zip(self.sums, whole)], dtype=object)

        def deviations(x: np.ndarray) -> tuple[list, list]:
            x = x - whole
            most = n * (int(np.abs(x).max(initial=0)) + 1)
            if most * most * size < _LONG:
                found = np.square(n * x - rest.astype(np.int64)).sum(axis=1).tolist()
            else:
                found = [sum(v * v for v in row) for row in x.astype(object) * n - rest]
            wide = [Decimal(v) if _LONG <= v < 10**38 else None for v in found]
            return [v if v < _LONG else None for v in found], wide

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("x"), size)
                for at in range(0, len(x), step := max(1, _CHUNK // size)):
                    piece = x[at : at + step]
                    fits, wide = deviations(piece)
                    y = centred(piece) @ scaled
                    ends = np.arange(0, y.size + 1, max(y.shape[1], 1)) if y.shape[1] else np.zeros(len(y) + 1, int)
                    yield pa.record_batch([
                        batch.column("id").slice(at, len(piece)), pa.array(fits, pa.int64()),
                        pa.array(wide, pa.decimal128(38, 0)),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(y.ravel())),
                    ], ["id", "deviation", "deviation_wide", "all"])

        return project


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, size)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for data, wide in zip(batch.column("x"), batch.column("wide").to_pylist()):
            x = np.frombuffer(data.as_buffer(), dtype="<i8" if wide else "<i4")
            yield x.astype(np.int64).reshape(-1, size) + SHIFT


def eigenpairs(product: Product, size: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric operator, falling, and their unit vectors.

    ``product`` applies the operator to a block of vectors.  A step takes the Ritz pairs of
    the search space, locks those whose residual is at rounding level (largest first, so none is
    passed over) and extends the space by the corrections of the others, for all of which
    each inner step is one product.
    """
    wanted = min(wanted, size)
    sought = min(size, wanted + GUARD)
    space = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, sought)))[0]
    images = product(space)
    locked, values = np.empty((size, 0)), []
    best, stalled = np.inf, 0
    for _ in range(OUTER_STEPS):
        inner = space.T @ images
        theta, turn = np.linalg.eigh((inner + inner.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, images = space @ turn, images @ turn
        residual = images - space * theta
        residual -= locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0) / max([*values, theta[0], np.finfo(float).tiny])
        # Once the leading residual stops falling, rounding is all that is left of it.
        stalled = stalled + 1 if norms[0] > best / 2 else 0
        best = min(best, norms[0])
        whole = space.shape[1] + locked.shape[1] == size
        enough = STALLED if stalled >= 3 or whole else TOLERANCE
        ready = int(np.argmax(np.append(norms > enough, True)))
        if ready:
            locked = np.linalg.qr(np.hstack([locked, space[:, :ready]]))[0]
            values += theta[:ready].tolist()
            space, images, theta, residual = space[:, ready:], images[:, ready:], theta[ready:], residual[:, ready:]
            best, stalled = np.inf, 0
        if len(values) >= wanted or not space.shape[1]:
            break
        if space.shape[1] > SPACE:
            space, images = space[:, : 2 * sought], images[:, : 2 * sought]
        block = min(max(sought - len(values), 1), space.shape[1], size - space.shape[1] - locked.shape[1])
        if block < 1:
            continue
        known = np.hstack([locked, space[:, :block]])
        more = corrections(product, known, theta[:block], residual[:, :block])
        more = _orthonormal(more, np.hstack([locked, space]))
        if not more.shape[1]:
            more = _orthonormal(np.random.default_rng(seed + len(values)).standard_normal((size, block)), np.hstack([locked, space]))
        space, images = np.hstack([space, more]), np.hstack([images, product(more)])
    else:
        raise ArithmeticError("eigenvectors did not settle")
    order = np.argsort(values, kind="stable")[::-1][:wanted]
    return np.array(values)[order], locked[:, order]


def corrections(product: Product, known: np.ndarray, theta: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Solves P (A - theta) P t = -residual for each column by MINRES; P leaves out ``known``.

    All columns take their Lanczos steps together.
    """

    def projected(v: np.ndarray) -> np.ndarray:
        return v - known @ (known.T @ v)

    right = projected(-residual)
    beta = np.linalg.norm(right, axis=0)
    eta, first = beta.copy(), beta.copy()
    live = beta > 0
    v, v_old = np.where(live, right / np.where(live, beta, 1), 0), np.zeros_like(right)
    x, w, w_old = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    cosine, cosine_old = np.ones_like(beta), np.ones_like(beta)
    sine, sine_old = np.zeros_like(beta), np.zeros_like(beta)
    beta = np.zeros_like(beta)
    for _ in range(INNER_STEPS):
        image = projected(product(v) - v * theta)
        alpha = (v * image).sum(axis=0)
        image = image - alpha * v - beta * v_old
        following = np.linalg.norm(image, axis=0)
        delta = cosine * alpha - cosine_old * sine * beta
        turned = np.hypot(delta, following)
        live &= turned > 0
        turned = np.where(live, turned, 1)
        second, third = sine * alpha + cosine_old * cosine * beta, sine_old * beta
        cosine_old, sine_old = cosine, sine
        cosine, sine = delta / turned, following / turned
        w_old, w = w, np.where(live, (v - third * w_old - second * w) / turned, 0)
        x += np.where(live, cosine * eta * w, 0)
        eta = -sine * eta
        live &= (np.abs(eta) > INNER_SHARE * first) & (following > 0)
        if not live.any():
            break
        v_old, v = v, np.where(following > 0, image / np.where(following > 0, following, 1), 0)
        beta = following
    return projected(x)


def _orthonormal(block: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Directions of ``block`` outside the space of ``others``, which is orthonormal."""
    length = np.linalg.norm(block, axis=0)
    block = block[:, length > 0] / length[length > 0]
    for _ in range(3):
        block = block - others @ (others.T @ block)
        left, strength, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, strength > 1e-10 * strength.max(initial=0)] if strength.max(initial=0) > 1e-13 else left[:, :0]
        if not block.shape[1]:
            break
    return block
