"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries become integers, ``floor(scale * c)``, and each distinct vector counts once: the fit list. Its scatter
``n * sum(x x') - sum(x) sum(x)'`` is made of exact integers; tasks multiply blocks whose sums a double holds
exactly, and Spark adds them up in limbs. It has the eigenvectors of the covariance and n * n times its eigenvalues.

Its characteristic polynomial is found modulo primes, by Hessenberg reduction, a prime per row of a Spark job, with as
many primes as a bound on the coefficients asks for, and put together by Chinese remainders. All its roots are real,
so by Descartes' rule the sign changes of the polynomial moved by t *count* the roots above t, repeated ones
included. Each component, again a row of a Spark job, halves an interval of dyadic numbers until its root is alone,
then by signs to ``PRECISION`` bits, and solves for the null space of the scatter less the root by inverse iteration
in ``DIGITS`` decimal digits. Roots that agree in all those bits share an interval and an orthonormal basis.

Only matrices and polynomials of the size of a vector are known to the driver and broadcast, whatever the rows.

Rows without a vector, with null, infinite or NaN entries, with entries whose scaled value no long holds, and empty
vectors are left out. If lengths differ, the most frequent one counts (the smaller of two), other rows are left
out. Repeated rows stay repeated; null ids stay. Components without variance are left out, so a table of equal
vectors, like an empty one, gives no rows. A deviation that no long holds is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, COMPONENTS = 64, 16
PRECISION, DIGITS = 110, 90
ROWS = 4096  # of a block: sums of so many products of two limbs are exact in a double
LIMB = 20  # bits
PARTS, PART = 6, 24  # of a sum on its way: 24 bits each, the last one signed
PRIME_BITS = 31


# --- rows ------------------------------------------------------------------------------------------------

def integers(embeddings: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id, x`` of the rows that count."""
    rows = embeddings.select(F.col(f"`{id_col}`").alias("vec_id"), F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double") * scale).alias("c"))
    fits = F.forall("c", lambda c: F.coalesce(F.abs(c) < 2.0 ** 62, F.lit(False)))  # false for null and NaN as well
    rows = rows.filter(F.col("c").isNotNull() & (F.size("c") > 0) & fits)
    length = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), "d").select("d").first()
    return rows.filter(F.size("c") == (length[0] if length else 0)).select("vec_id", F.transform("c", lambda c: F.floor(c)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """``x`` as doubles below 2 ** LIMB in size, lowest first; the sum of their shifted values is ``x``."""
    out = []
    while True:
        low = (x + (1 << LIMB - 1) & (1 << LIMB) - 1) - (1 << LIMB - 1)
        out.append(low.astype(np.float64))
        x = x - low >> LIMB
        if not x.any():
            return out


def products(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
    """Exact ``sum(x x')`` as Python integers; each vector is led by a one, for counts and sums."""
    total = None
    for x in blocks:
        parts = limbs(np.hstack([np.ones((len(x), 1), np.int64), x]))
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                part = (a.T @ b).astype(np.int64).astype(object) << LIMB * (i + j)
                total = part if total is None else total + part
    return total


def scatter(distinct: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """Number, sums and exact scatter of the vectors ``x``: as many rows come to the driver as x has entries."""
    def add_up(batches):
        blocks = (_matrix(batch["x"].slice(at, ROWS)) for batch in batches for at in range(0, batch.num_rows, ROWS))
        total = products(blocks)
        for i, row in enumerate([] if total is None else total):
            cut = [(int(v) >> PART * k) & (1 << PART) - 1 if k < PARTS - 1 else int(v) >> PART * k for v in row for k in range(PARTS)]
            yield pa.RecordBatch.from_pydict({"row": pa.array([i], pa.int32()), "cut": pa.array([cut], pa.list_(pa.int64()))})

    sums = (distinct.mapInArrow(add_up, "row int, cut array<bigint>").select("row", F.posexplode("cut").alias("at", "part"))
            .groupBy("row", "at").agg(F.sum("part").alias("part"))
            .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("cut")))
    found = sorted((r["row"], [p["part"] for p in r["cut"]]) for r in sums.toLocalIterator())
    if not found:
        return 0, [], np.zeros((0, 0), object)
    whole = np.array([[sum(cut[at + k] << PART * k for k in range(PARTS)) for at in range(0, len(cut), PARTS)] for _, cut in found], object)
    n, sums = int(whole[0, 0]), whole[0, 1:]
    return n, [int(s) for s in sums], n * whole[1:, 1:] - np.outer(sums, sums)


# --- polynomial ------------------------------------------------------------------------------------------

def is_prime(n: int) -> bool:
    return n > 1 and all(n % p for p in range(2, isqrt(n) + 1))


def primes(bits: int) -> list[int]:
    """Primes below 2 ** PRIME_BITS, largest first, whose product has more than ``bits`` bits."""
    found, product, candidate = [], 1, 1 << PRIME_BITS
    while product.bit_length() <= bits + 1:
        candidate -= 1
        if pow(2, candidate - 1, candidate) == 1 and is_prime(candidate):
            found.append(candidate)
            product *= candidate
    return found


def polynomial_mod(a: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t - a) modulo the prime ``p``, the lowest first, by reduction to Hessenberg form."""
    h = a.copy() % p
    d = len(h)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        pivot = k + int(below[0])
        if pivot != k:
            h[[k, pivot]] = h[[pivot, k]]
            h[:, [k, pivot]] = h[:, [pivot, k]]
        u = h[k + 1:, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1:] = (h[k + 1:] - u[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1:] * u % p).sum(axis=1)) % p
    # The polynomial of each leading block, from those of the smaller ones.
    poly = np.zeros((d + 1, d + 1), np.int64)
    poly[0, 0] = 1
    for k in range(1, d + 1):
        poly[k, 1:] = poly[k - 1, :-1]
        poly[k] = (poly[k] - int(h[k - 1, k - 1]) * poly[k - 1]) % p
        chain = 1
        for i in range(k - 1, 0, -1):
            chain = chain * int(h[i, i - 1]) % p
            if not chain:
                break
            poly[k] = (poly[k] - chain * int(h[i - 1, k - 1]) % p * poly[i - 1]) % p
    return poly[d].tolist()


def characteristic(spark, a: np.ndarray) -> list[int]:
    """Exact coefficients of det(t - a) of a positive semi-definite integer matrix, the lowest first."""
    d = len(a)
    mean = int(a.trace()) // d + 1
    bound = max(comb(d, k) * mean ** k for k in range(d + 1))  # the means of the roots' products fall with their degree
    moduli = primes(bound.bit_length() + 1)
    rows = a.tolist()

    def solve(batches):
        for batch in batches:
            for p in batch["p"].to_pylist():
                reduced = np.array([[v % p for v in row] for row in rows], np.int64)
                yield pa.RecordBatch.from_pydict({"p": pa.array([p], pa.int64()), "c": pa.array([polynomial_mod(reduced, p)], pa.list_(pa.int64()))})

    asked = spark.createDataFrame([(p,) for p in moduli], "p bigint").repartition(min(len(moduli), 2 * spark.sparkContext.defaultParallelism), "p")
    found = sorted((r["p"], r["c"]) for r in asked.mapInArrow(solve, "p bigint, c array<bigint>").toLocalIterator())
    value, modulus = [0] * (d + 1), 1
    for p, rest in found:
        inverse = pow(modulus, -1, p)
        value = [v + modulus * ((r - v) * inverse % p) for v, r in zip(value, rest)]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in value]


# --- roots -----------------------------------------------------------------------------------------------

def scaled(coefficients: list[int], shift: int) -> list[int]:
    """The polynomial of the roots times 2 ** shift."""
    d = len(coefficients) - 1
    return [c << shift * (d - k) for k, c in enumerate(coefficients)]


def roots_above(coefficients: list[int], t: int, shift: int) -> int:
    """How many roots exceed t / 2 ** shift, repeated ones counted as often."""
    moved = scaled(coefficients, shift)
    d = len(moved) - 1
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            moved[k] += t * moved[k + 1]
    signs = [c > 0 for c in moved if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def sign_at(coefficients: list[int], t: int, shift: int) -> int:
    value = 0
    for c in reversed(scaled(coefficients, shift)):
        value = value * t + c
    return (value > 0) - (value < 0)


def isolated(coefficients: list[int], k: int, largest: int, precision: int = PRECISION) -> tuple[int, int, int, int, int]:
    """``(low, high, shift, above, within)``: the k-th largest root lies in (low, high] / 2 ** shift, which holds
    ``within`` roots; ``above`` roots are larger. The width is 2 ** -precision of the root."""
    low, high, shift, above, upto = 0, largest + 1, 0, 0, roots_above(coefficients, 0, 0)
    while low.bit_length() <= precision or high - low > 1:
        if high - low == 1:
            low, high, shift = 2 * low, 2 * high, shift + 1
        mid = (low + high) // 2
        if upto - above > 1:
            found = roots_above(coefficients, mid, shift)
            right = found >= k
        else:  # one simple root: the sign at the upper end, or beyond it, is that of (-1) ** above
            sign = sign_at(coefficients, mid, shift)
            right = sign == (-1 if above % 2 == 0 else 1)
            found = upto if right else above
        if right:
            low, upto = mid, found
        else:
            high, above = mid, found
    return low, high, shift, above, upto - above


# --- components ------------------------------------------------------------------------------------------

def _solved(lu: np.ndarray, order: list[int], b: np.ndarray) -> np.ndarray:
    x = b[order].copy()
    for i in range(1, len(x)):
        x[i] -= lu[i, :i] @ x[:i]
    for i in range(len(x) - 1, -1, -1):
        x[i] = (x[i] - (lu[i, i + 1:] @ x[i + 1:] if i + 1 < len(x) else 0)) / lu[i, i]
    return x


def null_space(a: np.ndarray, root: Decimal, size: int, digits: int = DIGITS) -> np.ndarray:
    """Orthonormal columns that ``a - root`` maps to nothing, as near as ``root`` is to an eigenvalue."""
    d = len(a)
    with localcontext() as context:
        context.prec = digits
        least = abs(root) * Decimal(10) ** -(digits - 5)
        lu = np.array([[Decimal(int(v)) for v in row] for row in a], object)
        lu[np.diag_indices(d)] -= root
        order = list(range(d))
        for i in range(d):
            pivot = i + int(np.argmax(np.abs(lu[i:, i])))
            if pivot != i:
                lu[[i, pivot]] = lu[[pivot, i]]
                order[i], order[pivot] = order[pivot], order[i]
            if abs(lu[i, i]) < least:
                lu[i, i] = least
            lu[i + 1:, i] /= lu[i, i]
            lu[i + 1:, i + 1:] -= np.outer(lu[i + 1:, i], lu[i, i + 1:])
        start = np.random.default_rng(d).integers(-1000, 1000, (size, d))
        found = [np.array([Decimal(int(v)) for v in row], object) for row in start]
        for _ in range(3):
            basis = []
            for v in found:
                v = _solved(lu, order, v)
                v /= (v @ v).sqrt()
                for _ in range(2):
                    for other in basis:
                        v = v - (v @ other) * other
                v /= (v @ v).sqrt()
                basis.append(v)
            found = basis
        return np.array(found, object).T


def components(spark, coefficients: list[int], a: np.ndarray, count: int) -> list[tuple[int, Decimal, list[float]]]:
    """Number, eigenvalue of ``a`` and unit eigenvector of the ``count`` largest roots above zero."""
    rank = len(coefficients) - 1 - next(k for k, c in enumerate(coefficients) if c)
    largest, rows = int(a.trace()), a.tolist()

    def solve(batches):
        matrix = np.array(rows, object)
        for batch in batches:
            for k in batch["k"].to_pylist():
                low, high, shift, above, within = isolated(coefficients, k, largest)
                with localcontext() as context:
                    context.prec = DIGITS
                    root = Decimal(low + high) / Decimal(2 << shift)
                vector = null_space(matrix, root, within)[:, k - above - 1]
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "root": pa.array([str(root)]), "v": pa.array([list(map(float, vector))], pa.list_(pa.float64()))})

    wanted = min(count, rank)
    if not wanted:
        return []
    asked = spark.createDataFrame([(k,) for k in range(1, wanted + 1)], "k int").repartition(wanted, "k")
    return sorted((r["k"], Decimal(r["root"]), r["v"]) for r in asked.mapInArrow(solve, "k int, root string, v array<double>").toLocalIterator())


def whiten(embeddings: DataFrame, count: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per row and component.

    ``deviation`` is a row's sum of (n * x - S) ** 2, ``explained`` the component's share of the variance, and
    ``identity_error`` how far the covariance of ``whitened`` over the fit list is from the identity at most.
    """
    spark = embeddings.sparkSession
    rows = integers(embeddings, id_col, vector_col, scale)
    distinct = rows.select("x").distinct()
    n, sums, a = scatter(distinct)
    found = components(spark, characteristic(spark, a), a, count) if n else []
    with localcontext() as context:
        context.prec = DIGITS
        trace = int(a.trace()) if n else 1
        explained = [float(e / trace) for _, e, _ in found]
        # x - S / n times n is whole: project n * x - S, and divide by n times the root of the covariance's eigenvalue.
        lengths = [float(1 / e.sqrt()) for _, e, _ in found]
    axes = np.array([v for _, _, v in found]).reshape(len(found), -1).T * lengths if found else np.zeros((0, 0))
    bound = 1 << 62

    def centred(x: np.ndarray) -> np.ndarray:
        """n * x - S, as whole numbers."""
        top = max(n * max(abs(int(x.min())), abs(int(x.max()))), *map(abs, sums)) if len(x) else 0
        return n * x - np.array(sums, np.int64) if 2 * top < bound else n * x.astype(object) - np.array(sums, object)

    def deviations(z: np.ndarray) -> list[int | None]:
        if z.dtype != object and len(z) and int(np.abs(z).max()) ** 2 * z.shape[1] < bound:
            return (z * z).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in z]
        return [v if v < 1 << 63 else None for v in exact]

    def projected(z: np.ndarray) -> np.ndarray:
        return z.astype(np.float64) @ axes

    def squares(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                w = projected(centred(_matrix(batch["x"].slice(at, ROWS))))
                part = np.vstack([w.sum(axis=0), w.T @ w])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

    error = None
    if found:
        added = (distinct.mapInArrow(squares, "part array<double>").select(F.posexplode("part").alias("at", "v"))
                 .groupBy("at").agg(F.sum("v").alias("v")))
        flat = dict(map(tuple, added.toLocalIterator()))  # one number per pair of components
        whole = np.array([flat[i] for i in range(len(flat))]).reshape(len(found) + 1, -1) / n
        error = float(np.abs(whole[1:] - np.outer(whole[0], whole[0]) - np.eye(len(found))).max())

    def score(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                z = centred(_matrix(part["x"]))
                w, far, m = projected(z), deviations(z), len(found)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part["vec_id"].take(pa.array(np.repeat(np.arange(len(z)), m))),
                    "component": pa.array(np.tile(np.arange(1, m + 1), len(z)), pa.int32()),
                    "n": pa.array(np.full(len(z) * m, n), pa.int64()),
                    "deviation": pa.array([v for v in far for _ in range(m)], pa.int64()),
                    "whitened": pa.array(w.ravel(), pa.float64()),
                    "explained": pa.array(np.tile(explained, len(z)), pa.float64()),
                    "identity_error": pa.array(np.full(len(z) * m, error), pa.float64())})

    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    return (rows if found else rows.filter("false")).mapInArrow(score, schema)
