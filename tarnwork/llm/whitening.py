"""Whitening of embeddings by an exact characteristic polynomial.

Every entry c becomes the integer x = floor(64 c) + 1,000,000.  The scatter of
all rows is summed exactly as integers (tasks add float products that are exact
below 2**53 and hand on whole numbers), so the large offset costs no digits and
A = n * sum(x x') - S S' is the covariance times n squared without any rounding.

The characteristic polynomial of A is computed modulo 31-bit primes, one prime
a row of a Spark job (Hessenberg form, then the recurrence of its leading
minors), and put together by Chinese remaindering.  All its roots are real, so
the sign changes of the shifted polynomial count the roots above a point
exactly; bisection isolates the largest ones and refines them to 96 binary
places.  The components are found by inverse iteration in the null space of
A - root in fixed-point integers, one root a row of a Spark job; roots that
agree in all 96 places share one orthonormal basis.

Vectors that are null, hold a null or a non-finite entry, or have another
length than most (the longest of the most frequent lengths is taken) are
dropped.  A null or repeated id is kept: each remaining row gives its own
result, and repeated rows count each time.  Components with eigenvalue zero
cannot be whitened and are left out, so constant columns, a single row or an
empty table give fewer components or none.  Values of 64 c beyond 2**62 count
as 2**62, and a deviation of more than 38 digits is null.  Other columns pass
through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import prepare, with_columns

SCALE, OFFSET = 64, 1_000_000
LARGEST = 1 << 62
COMPONENTS = 32
# Binary places of the roots, and of the numbers in the inverse iteration.
PLACES, WORKING = 96, 224
ROWS_PER_PRODUCT = 4096
_LOW = 1 << 40
_DIGITS = Context(prec=400)


# ---- rows ------------------------------------------------------------------


def finite(column: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    inside = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return column.isNotNull() & F.coalesce(F.forall(column.cast("array<double>"), inside), F.lit(False))


def usual_length(df: DataFrame, column: str) -> int:
    """The most frequent length of the finite vectors, the longest one if several are; 0 without any."""
    lengths = df.where(finite(F.col(column))).groupBy(F.size(column).alias("d")).count()
    row = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    return row.d if row else 0


def usable(df: DataFrame, column: str, length: int) -> DataFrame:
    return df.where(finite(F.col(column)) & (F.size(column) == length))


def integers(vectors: pa.Array, length: int) -> np.ndarray:
    """floor(64 c) of a batch, without the offset, which cancels in everything that is centred."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(flat * SCALE)
    return np.clip(whole, -float(LARGEST), float(LARGEST)).astype(np.int64).reshape(-1, length)


def _products(z: np.ndarray) -> np.ndarray:
    """z' z in whole numbers."""
    total = np.zeros((z.shape[1], z.shape[1]), object)
    for at in range(0, len(z), ROWS_PER_PRODUCT):
        part = z[at : at + ROWS_PER_PRODUCT]
        if max(int(part.max(initial=0)), -int(part.min(initial=0))) < 1 << 20:
            f = part.astype(np.float64)
            total += (f.T @ f).astype(np.int64)
        else:
            big = part.astype(object)
            total += big.T @ big
    return total


def scatter(df: DataFrame, column: str, length: int) -> tuple[int, list[int], np.ndarray]:
    """Row count, sums, and n * sum(z z') - sum(z) sum(z)' as whole numbers.  The driver gets length**2 / 2 of them."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, pairs = 0, np.zeros(length, object), np.zeros((length, length), object)
        for batch in batches:
            z = integers(batch.column(0), length)
            n += len(z)
            sums += z.astype(object).sum(axis=0)
            pairs += _products(z)
        if n:
            up, along = np.triu_indices(length)
            values = [n, *sums, *pairs[up, along]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([-1, *[-1] * length, *up.tolist()], pa.int32()),
                    pa.array([-1, *range(length), *along.tolist()], pa.int32()),
                    pa.array([Decimal(int(v) // _LOW) for v in values], pa.decimal128(38, 0)),
                    pa.array([int(v) % _LOW for v in values], pa.int64()),
                ],
                names=["i", "j", "high", "low"],
            )

    parts = df.select(column).mapInArrow(partial, "i int, j int, high decimal(38,0), low long")
    sums = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    n, single, pairs = 0, [0] * length, np.zeros((length, length), object)
    for row in sums.collect():
        value = int(row.high) * _LOW + int(row.low)
        if row.j < 0:
            n = value
        elif row.i < 0:
            single[row.j] = value
        else:
            pairs[row.i, row.j] = pairs[row.j, row.i] = value
    own = np.array(single, object)
    return n, single, n * pairs - np.outer(own, own)


# ---- characteristic polynomial ---------------------------------------------


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every number below 3.2e9."""
    if n < 4:
        return n > 1
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        if n % base == 0:
            return n == base
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_below(limit: int, bits: int) -> list[int]:
    """The largest primes below ``limit`` whose product has more than ``bits`` bits."""
    found, have, n = [], 0.0, limit - 1
    while have <= bits:
        if _is_prime(n):
            found.append(n)
            have += math.log2(n) - 1e-9
        n -= 1
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo p, from the constant on, by the Hessenberg form."""
    d = len(matrix)
    h = (matrix % p).astype(np.int64)
    for m in range(1, d - 1):
        at = np.flatnonzero(h[m:, m - 1])
        if not len(at):
            continue
        k = m + int(at[0])
        if k != m:
            h[[k, m]] = h[[m, k]]
            h[:, [k, m]] = h[:, [m, k]]
        factor = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factor[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factor % p).sum(axis=1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        last = minors[k - 1]
        own = np.roll(last, 1)
        own = (own - last * h[k - 1, k - 1]) % p
        weights, product = np.zeros(k - 1, np.int64), 1
        for m in range(k - 1, 0, -1):
            product = product * int(h[m, m - 1]) % p
            weights[m - 1] = product * int(h[m - 1, k - 1]) % p
        if k > 1:
            own = (own - (weights[:, None] * minors[: k - 1] % p).sum(axis=0)) % p
        minors[k] = own
    return minors[d]


def coefficient_bits(matrix: np.ndarray) -> int:
    """Bits that hold any coefficient: the k-th is at most C(d, k) (trace / d)**k, as no root is negative."""
    d = len(matrix)
    mean = int(sum(matrix[i, i] for i in range(d))) // d + 1
    return d + d * mean.bit_length() + 2


def characteristic_polynomial(spark, matrix: np.ndarray) -> list[int]:
    """Whole coefficients of det(x - matrix), from the constant on, for a matrix without negative eigenvalues.

    Each prime is a row of a Spark job; the driver gets one number per prime and coefficient.
    """
    primes = primes_below(1 << 31, coefficient_bits(matrix))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [primes[k] for k in batch.column(0).to_pylist()]
            rests = [polynomial_modulo(matrix, p).tolist() for p in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(rests, pa.list_(pa.int64()))], names=["p", "rests"])

    tasks = max(1, min(len(primes), 4 * spark.sparkContext.defaultParallelism))
    rows = spark.range(0, len(primes), 1, tasks).mapInArrow(reduced, "p long, rests array<long>").collect()
    whole = math.prod(primes)
    sums = [0] * (len(matrix) + 1)
    for row in rows:
        share = whole // row.p
        share *= pow(share, -1, row.p)
        for k, rest in enumerate(row.rests):
            sums[k] += share * rest
    return [s - whole if s * 2 > whole else s for s in (s % whole for s in sums)]


# ---- roots -----------------------------------------------------------------


def _value(poly: list[int], a: int) -> int:
    out = 0
    for c in reversed(poly):
        out = out * a + c
    return out


def roots_above(poly: list[int], a: int) -> int:
    """Number of roots greater than a, with multiplicity: sign changes of the polynomial moved by a.

    Descartes' rule is an equality here, as all roots are real.
    """
    moved = list(poly)
    for k in range(len(moved) - 1):
        for j in range(len(moved) - 2, k - 1, -1):
            moved[j] += a * moved[j + 1]
    signs = [c > 0 for c in moved if c]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def largest_roots(poly: list[int], most: int, places: int = PLACES) -> list[tuple[int, int]]:
    """(root * 2**places rounded up, multiplicity) of the largest positive roots, falling.

    Bisection over whole multiples of 2**-places: an interval with one root is refined by signs, one with several by
    counts; roots that are not told apart at this width are one root with their number as multiplicity.
    """
    d = len(poly) - 1
    scaled = [c << (places * (d - k)) for k, c in enumerate(poly)]
    top = 1 << max(1, -poly[d - 1]).bit_length() + places
    found, have = [], 0
    open_intervals = [(0, top, roots_above(scaled, 0), 0)]
    while open_intervals and have < most:
        low, high, above_low, above_high = open_intervals.pop()
        n = above_low - above_high
        if n == 0:
            continue
        if high - low == 1:
            found.append((high, n))
            have += n
        elif n == 1:
            sign = _value(scaled, high) > 0 if _value(scaled, high) else None
            while sign is not None and high - low > 1:
                middle = (low + high) // 2
                value = _value(scaled, middle)
                if value == 0:
                    low, high = middle - 1, middle
                elif (value > 0) == sign:
                    high = middle
                else:
                    low = middle
            found.append((high, 1))
            have += 1
        else:
            middle = (low + high) // 2
            above = roots_above(scaled, middle)
            open_intervals.append((low, middle, above_low, above))
            open_intervals.append((middle, high, above, above_high))
    return found


# ---- components ------------------------------------------------------------


def null_space(matrix: np.ndarray, root: int, size: int, places: int = PLACES, working: int = WORKING) -> np.ndarray:
    """``size`` orthonormal vectors (columns) by inverse iteration for the eigenvalue root / 2**places.

    Fixed-point numbers with ``working`` binary places; four solves, far more than the digits of a double need.
    """
    d = len(matrix)
    m = matrix * (1 << working)
    for i in range(d):
        m[i, i] -= root << (working - places)
    order = list(range(d))
    for k in range(d):
        at = k + max(range(d - k), key=lambda i: abs(m[k + i, k]))
        if at != k:
            m[[k, at]] = m[[at, k]]
            order[k], order[at] = order[at], order[k]
        if m[k, k] == 0:
            m[k, k] = 1
        if k + 1 < d:
            factors = (m[k + 1 :, k] << working) // m[k, k]
            m[k + 1 :, k + 1 :] -= (factors[:, None] * m[k, k + 1 :]) >> working
            m[k + 1 :, k] = factors
    one = 1 << working

    def solved(b: np.ndarray) -> np.ndarray:
        x = b[order]
        for k in range(1, d):
            x[k] -= (m[k, :k] @ x[:k]) >> working
        for k in range(d - 1, -1, -1):
            x[k] = ((x[k] << working) - (m[k, k + 1 :] @ x[k + 1 :] if k + 1 < d else 0)) // m[k, k]
        return x

    def orthonormal(columns: list[np.ndarray]) -> list[np.ndarray]:
        done: list[np.ndarray] = []
        for v in columns:
            largest = max(1, *(abs(int(x)) for x in v))
            v = (v << working) // largest
            for _ in range(2):
                for u in done:
                    v = v - ((u * (int(u @ v) >> working)) >> working)
            length = max(1, math.isqrt(int(v @ v)))
            done.append((v << working) // length)
        return done

    start = np.random.default_rng(size)
    basis = [np.array([int(x) * (one >> 20) for x in start.integers(1, 1 << 20, d)], object) for _ in range(size)]
    for _ in range(4):
        basis = orthonormal([solved(v) for v in basis])
    return np.array([[int(x) / one for x in v] for v in basis]).T


@dataclass(frozen=True)
class Whitening:
    """What a fit knows: row count, sums of 64 c, components as columns, their roots (covariance times n squared) and shares."""

    length: int
    n: int
    sums: list[int]
    components: np.ndarray
    roots: np.ndarray
    explained: list[float]


def fit(df: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> Whitening:
    spark = prepare(df.sparkSession)
    length = usual_length(df, column)
    empty = Whitening(length, 0, [0] * length, np.zeros((length, 0)), np.zeros(0), [])
    if not length:
        return empty
    n, sums, matrix = scatter(usable(df, column, length), column, length)
    trace = int(sum(matrix[i, i] for i in range(length)))
    if trace == 0:
        return Whitening(length, n, sums, np.zeros((length, 0)), np.zeros(0), [])
    roots = largest_roots(characteristic_polynomial(spark, matrix), most)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                vectors = null_space(matrix, *roots[k]).T.tolist()
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([vectors], pa.list_(pa.list_(pa.float64())))], names=["k", "vectors"])

    found = spark.range(0, len(roots), 1, len(roots)).mapInArrow(solved, "k long, vectors array<array<double>>").collect()
    columns, values, shares = [], [], []
    for row in sorted(found, key=lambda r: r.k):
        root = _DIGITS.divide(Decimal(roots[row.k][0]), Decimal(1 << PLACES))
        for vector in row.vectors[: most - len(columns)]:
            columns.append(vector)
            values.append(float(root))
            shares.append(float(_DIGITS.divide(root, Decimal(trace))))
    return Whitening(length, n, sums, np.array(columns).T, np.array(values), shares)


def whiten(df: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """The usable rows with ``whitened`` (array, one entry per component) and ``deviation`` (sum of (n x - S)**2, exact)."""
    prepare(df.sparkSession)
    projection = model.components / np.sqrt(model.roots)
    sums, n, length = model.sums, model.n, model.length

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        for batch in batches:
            z = integers(batch.column(batch.schema.get_field_index(column)), length) if length else np.zeros((0, 0), np.int64)
            largest = max(int(z.max(initial=0)), -int(z.min(initial=0)))
            reach = n * largest + max((abs(s) for s in sums), default=0)
            if reach * reach * max(length, 1) < 1 << 63:
                centred = z * n - np.array(sums, np.int64)
                deviations = (centred * centred).sum(axis=1)
            else:
                centred = z.astype(object) * n - np.array(sums, object)
                deviations = (centred * centred).sum(axis=1)
            values = centred.astype(np.float64) @ projection
            yield {
                "whitened": pa.array(list(values), pa.list_(pa.float64())),
                "deviation": pa.array([Decimal(int(x)) if x < 10**38 else None for x in deviations], pa.decimal128(38, 0)),
            }

    return with_columns(usable(df, column, length), "whitened array<double>, deviation decimal(38,0)", make)


def identity_error(rows: DataFrame, size: int, column: str = "whitened") -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity.

    The rows are centred already, so products are summed in one pass; what is left of the mean is taken off.
    """
    if not size:
        return 0.0

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, pairs = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            w = batch.column(0).flatten().to_numpy().reshape(-1, size)
            n += len(w)
            sums += w.sum(axis=0)
            pairs += w.T @ w
        if n:
            up, along = np.triu_indices(size)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([-1, *[-1] * size, *up.tolist()], pa.int32()),
                    pa.array([-1, *range(size), *along.tolist()], pa.int32()),
                    pa.array([float(n), *sums, *pairs[up, along]], pa.float64()),
                ],
                names=["i", "j", "s"],
            )

    sums = rows.select(column).mapInArrow(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    by_place = {(r.i, r.j): r.s for r in sums}
    n = by_place.get((-1, -1), 0.0)
    if not n:
        return 0.0
    mean = [by_place[-1, k] / n for k in range(size)]
    return max(abs(s / n - mean[i] * mean[j] - (i == j)) for (i, j), s in by_place.items() if i >= 0)


def components(df: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Each usable row with ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    model = fit(df, column, most)
    rows = whiten(df, model, column)
    error = identity_error(rows, len(model.roots))
    names = {"component", "n", "explained", "identity_error", "whitened", "deviation"}
    kept = [f"`{c}`" for c in rows.columns if c.lower() not in names]
    each = rows.select(*kept, "deviation", F.posexplode("whitened").alias("__at", "whitened"))
    shares = F.array(*(F.lit(x) for x in model.explained)) if model.explained else F.array().cast("array<double>")
    return each.select(
        *kept,
        (F.col("__at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("__at") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
