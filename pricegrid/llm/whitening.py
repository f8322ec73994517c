"""Whitening of vectors by principal components from an exact characteristic polynomial."""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrid.llm.common import query, read
from pricegrid.session import written

#: entries become whole numbers floor(SCALE * c) + SHIFT
SCALE, SHIFT = 1024, 100_000
#: whole numbers beyond this are held at it, as they would not fit a long
MOST = float(1 << 61)
#: doubles hold whole numbers up to this exactly
EXACT = 1 << 53
#: whole sums travel in pieces of so many bits, which add up in longs
LIMB = 32
#: binary digits of roots, relative to their size, and of the fractions in the null-space iteration
ROOT_BITS, WORK_BITS = 200, 640


def usable(vector: Column) -> Column:
    """Vectors without null or non-finite entries."""
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))), F.lit(False))


def whole(batch: pa.Array, dims: int) -> np.ndarray:
    """floor(SCALE * c) of a batch of vectors, one a row, as doubles, which hold them exactly."""
    flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(SCALE * flat), -MOST, MOST).reshape(-1, dims)


def _ints(values: np.ndarray) -> np.ndarray:
    out = np.empty(values.shape, dtype=object)
    out.ravel()[:] = [int(v) for v in values.ravel().tolist()]
    return out


def _sums(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Exact sums of a partition, cut into limbs: number of rows, sums of each entry, sums of products."""
    rows, first, second = 0, np.zeros(dims, dtype=object), np.zeros((dims, dims), dtype=object)
    for batch in batches:
        y = whole(batch.column(0), dims)
        if not len(y):
            continue
        rows += len(y)
        largest = float(np.abs(y).max())
        step = len(y) if not largest else int(min(len(y), EXACT // max(1, int(largest) ** 2)))
        if step:
            # every partial sum of the product is a whole number below 2^53, so the doubles are exact in any order
            for at in range(0, len(y), step):
                part = y[at:at + step]
                first = first + part.sum(axis=0).astype(np.int64).astype(object)
                second = second + (part.T @ part).astype(np.int64).astype(object)
        else:
            exact = _ints(y)
            first, second = first + exact.sum(axis=0), second + exact.T @ exact
    values = [rows, *first.tolist(), *second[np.triu_indices(dims)].tolist()]
    place, limb, part = [], [], []
    for i, v in enumerate(values):
        k = 0
        while v:
            low = v & ((1 << LIMB) - 1) if not -(1 << LIMB) < v < (1 << LIMB) else v
            place.append(i), limb.append(k), part.append(low)
            v, k = (v - low) >> LIMB, k + 1
    yield pa.RecordBatch.from_arrays(
        [pa.array(place, pa.int64()), pa.array(limb, pa.int64()), pa.array(part, pa.int64())], names=["place", "limb", "part"])


def scatter(vectors: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows, sums and n times the sums of products less the products of sums, all exact, of the whole numbers
    without SHIFT (the last is the same with it). A partition gives one row for each pair of dimensions and limb; they
    are added up by Spark, so that the driver gets a number of rows that only the dimension decides."""
    parts = vectors.mapInArrow(lambda b: _sums(b, dims), "place long, limb long, part long")
    values = [0] * (1 + dims + dims * (dims + 1) // 2)
    for r in parts.groupBy("place", "limb").agg(F.sum("part").alias("part")).collect():
        values[r["place"]] += r["part"] << (LIMB * r["limb"])
    n, first, second = values[0], values[1:1 + dims], iter(values[1 + dims:])
    out = [[0] * dims for _ in range(dims)]
    for i in range(dims):
        for j in range(i, dims):
            out[i][j] = out[j][i] = n * next(second) - first[i] * first[j]
    return n, first, out


# the exact characteristic polynomial -------------------------------------------------------------------------------


def is_prime(n: int) -> bool:
    """Exact for all n below 3,215,031,751 (strong probable primes to the bases 2, 3, 5 and 7)."""
    if n < 2 or any(n % p == 0 and n != p for p in (2, 3, 5, 7)):
        return False
    if n in (2, 3, 5, 7):
        return True
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def enough_primes(matrix: Sequence[Sequence[int]]) -> list[int]:
    """Primes below 2^31 whose product exceeds twice any coefficient. The matrix has no negative eigenvalues, so the k-th
    coefficient is at most C(d, k) * (trace / d)^k."""
    d = len(matrix)
    mean = -(-sum(matrix[i][i] for i in range(d)) // d)
    most = 2 * max(math.comb(d, k) * mean**k for k in range(d + 1)) + 1
    primes, product, n = [], 1, (1 << 31) - 1
    while product <= most:
        if is_prime(n):
            primes.append(n)
            product *= n
        n -= 2
    return primes


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x I - matrix) modulo p, lowest power first: similarity steps bring the matrix to Hessenberg
    form, then the polynomials of its leading blocks follow from one another. Products stay below 2^62."""
    h, d = matrix % p, len(matrix)
    for k in range(d - 2):
        filled = np.flatnonzero(h[k + 1:, k])
        if not len(filled):
            continue
        pivot = k + 1 + int(filled[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        u = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * u % p).sum(axis=1)) % p
    blocks = np.zeros((d + 1, d + 1), np.int64)
    blocks[0, 0] = 1
    for m in range(1, d + 1):
        new = np.zeros(d + 1, np.int64)
        new[1:] = blocks[m - 1, :-1]
        factors, below = np.zeros(m, np.int64), 1
        for i in range(m):
            factors[m - 1 - i] = int(h[m - 1 - i, m - 1]) * below % p
            below = below * int(h[m - 1 - i, m - 2 - i]) % p if i < m - 1 else 0
        blocks[m] = (new - (factors[:, None] * blocks[:m] % p).sum(axis=0)) % p
    return blocks[d].tolist()


def remaindered(residues: Iterable[tuple[int, Sequence[int]]], length: int) -> list[int]:
    """The whole numbers, of either sign, with these residues (Chinese remainder theorem)."""
    values, product = [0] * length, 1
    for p, found in residues:
        inverse = pow(product % p, -1, p)
        values = [v + product * ((r - v) * inverse % p) for v, r in zip(values, found, strict=True)]
        product *= p
    return [v - product if 2 * v > product else v for v in values]


def characteristic_polynomial(spark: SparkSession, matrix: Sequence[Sequence[int]]) -> list[int]:
    """Exact coefficients, lowest power first. One Spark row a prime; the driver gets the residues, whose number depends
    on the dimension and the size of the entries only."""
    d = len(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            primes = batch.column(0).to_pylist()
            found = [polynomial_mod(np.array([[v % p for v in row] for row in matrix], np.int64), p) for p in primes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["p", "c"])

    primes = enough_primes(matrix)
    tasks = min(len(primes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(run, "p long, c array<long>")
    return remaindered(((r["p"], r["c"]) for r in rows.collect()), d + 1)


# roots ---------------------------------------------------------------------------------------------------------------


def roots_above(coefficients: Sequence[int], a: int, s: int) -> int:
    """How many roots, with their multiplicity, of a polynomial with real roots only exceed a / 2^s: the changes of sign
    in the coefficients of p(x + a / 2^s), which Descartes' rule counts exactly then."""
    d = len(coefficients) - 1
    c = [v << (s * (d - j)) for j, v in enumerate(coefficients)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _sign(coefficients: Sequence[int], a: int, s: int) -> int:
    d, v = len(coefficients) - 1, 0
    for j in range(d, -1, -1):
        v = v * a + (coefficients[j] << (s * (d - j)))
    return (v > 0) - (v < 0)


def largest_roots(coefficients: Sequence[int], most: int) -> list[tuple[int, int, int]]:
    """(a, s, number): the ``most`` largest positive roots a / 2^s of a polynomial with real roots, none negative, falling;
    ``number`` roots that agree in ROOT_BITS binary digits stand together. Intervals are halved by exact counts until each
    holds one root or is that narrow, then by the sign of the polynomial."""
    zeros = next(j for j, v in enumerate(coefficients) if v)
    c = list(coefficients[zeros:])
    out: list[tuple[int, int, int]] = []
    # (low, high] as numerators over 2^s, with the numbers of roots above; no root exceeds the sum of all
    pending = [(0, 1 << (-c[-2]).bit_length(), 0, len(c) - 1, 0)] if len(c) > 1 else []
    while pending and sum(n for _, _, n in out) < most:
        low, high, s, above_low, above_high = pending.pop()
        held = above_low - above_high
        if not held:
            continue
        width = high - low
        if held == 1 or (low > 0 and low.bit_length() - width.bit_length() > ROOT_BITS):
            if held == 1:
                low, high, s = _narrowed(c, low, high, s, above_high)
            out.append((low + high, s + 1, held))
            continue
        middle = low + high
        n = roots_above(c, middle, s + 1)
        pending.append((2 * low, middle, s + 1, above_low, n))
        pending.append((middle, 2 * high, s + 1, n, above_high))
    return out


def _narrowed(c: Sequence[int], low: int, high: int, s: int, above: int) -> tuple[int, int, int]:
    """Halve the interval of one root until it is ROOT_BITS finer than both the root and the interval it came with."""
    extra = 0
    while extra < ROOT_BITS or low == 0 or low.bit_length() - (high - low).bit_length() <= ROOT_BITS:
        middle, low, high, s = low + high, 2 * low, 2 * high, s + 1
        sign = _sign(c, middle, s)
        # above the root the sign is that of the roots above it
        if sign == (-1) ** (above + 1):
            low = middle
        else:
            high = middle
        extra += 1
        if sign == 0:
            return middle - 1, middle + 1, s
    return low, high, s


# components ----------------------------------------------------------------------------------------------------------


def _eliminated(a: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Rows eliminated with pivots, in fractions of WORK_BITS binary digits; a pivot of zero becomes the least fraction."""
    a, order = a.copy(), []
    for k in range(len(a)):
        pivot = max(range(k, len(a)), key=lambda i: abs(a[i, k]))
        order.append(pivot)
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
        if not a[k, k]:
            a[k, k] = 1
        for i in range(k + 1, len(a)):
            m = (a[i, k] << WORK_BITS) // a[k, k]
            a[i, k + 1:] -= (m * a[k, k + 1:]) >> WORK_BITS
            a[i, k] = m
    return a, order


def _solved(lu: np.ndarray, order: Sequence[int], b: list[int]) -> list[int]:
    b, d = list(b), len(lu)
    for k, pivot in enumerate(order):
        b[k], b[pivot] = b[pivot], b[k]
    for k in range(d):
        b[k] -= sum((lu[k, j] * b[j]) >> WORK_BITS for j in range(k))
    for k in range(d - 1, -1, -1):
        rest = b[k] - sum((lu[k, j] * b[j]) >> WORK_BITS for j in range(k + 1, d))
        b[k] = (rest << WORK_BITS) // lu[k, k]
    return b


def _unit(v: Sequence[int]) -> list[int]:
    # long vectors are cut down to their leading digits first
    down = max(0, max(abs(x).bit_length() for x in v) - 2 * WORK_BITS)
    v = [x >> down for x in v]
    length = math.isqrt(sum(x * x for x in v))
    return [(x << WORK_BITS) // length for x in v]


def _apart(v: list[int], others: Sequence[Sequence[int]]) -> list[int]:
    for o in others:
        along = sum(x * y for x, y in zip(v, o, strict=True)) >> WORK_BITS
        v = [x - ((along * y) >> WORK_BITS) for x, y in zip(v, o, strict=True)]
    return v


def null_vectors(matrix: Sequence[Sequence[int]], a: int, s: int, number: int) -> list[list[float]]:
    """``number`` orthogonal unit vectors that the matrix without its eigenvalue a / 2^s takes to next to nothing: inverse
    iteration in fractions of WORK_BITS binary digits. The largest entry of each is positive."""
    d = len(matrix)
    root = (a << WORK_BITS) >> s
    shifted = np.empty((d, d), dtype=object)
    for i in range(d):
        shifted[i] = [v << WORK_BITS for v in matrix[i]]
        shifted[i, i] -= root
    lu, order = _eliminated(shifted)
    found: list[list[int]] = []
    for k in range(number):
        # starts that have shares of their own in the wanted directions
        numbers = random.Random(k)
        v = _unit([numbers.getrandbits(62) - (1 << 61) << WORK_BITS for _ in range(d)])
        for _ in range(3):
            v = _unit(_apart(_unit(_solved(lu, order, _apart(v, found))), found))
        found.append(v)
    out = []
    for v in found:
        largest = max(v, key=abs)
        out.append([(x if largest > 0 else -x) / (1 << WORK_BITS) for x in v])
    return out


class Components:
    """The fit: number of rows, sums and, for each component, its unit vector, root of n^2 times its variance, and share
    of the total variance."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, deviations: np.ndarray, shares: list[float]):
        self.n, self.sums, self.vectors, self.deviations, self.shares = n, sums, vectors, deviations, shares


def fit(vectors: DataFrame, vector: str, dims: int, most: int = 8) -> Components:
    """Components of the vectors, which all have ``dims`` finite entries. Fewer than ``most`` come back where fewer
    directions have any variance."""
    n, sums, matrix = scatter(vectors.select(vector), dims)
    trace = sum(matrix[i][i] for i in range(dims))
    columns, deviations, shares = [], [], []
    if trace:
        for a, s, number in largest_roots(characteristic_polynomial(vectors.sparkSession, matrix), most):
            for v in null_vectors(matrix, a, s, number):
                columns.append(v)
                # sqrt(a / 2^s), from whole numbers
                deviations.append(math.isqrt((a << 128) << (s % 2)) / (1 << (64 + (s + s % 2) // 2)))
                shares.append(a / (trace << s))
    return Components(n, sums, np.array(columns[:most]).reshape(-1, dims), np.array(deviations[:most]), shares[:most])


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = 8) -> tuple[DataFrame, Components]:
    """(``vec_id, deviation, z``, fit): of each usable vector the squared distance from the mean, in whole numbers times
    n^2, and its whitened coordinates, an array with one entry a component.

    Null vectors and vectors with null or non-finite entries are dropped, as are those of another length than most of
    the usable ones (of equally many lengths, the longest). Entries c become floor(1024 c) + 100000, so that all sums are
    exact; c beyond 2^51 are held there. Equal variances give any orthonormal vectors of their space. Directions without
    variance are no components. A deviation beyond a long is null. Null ids, ties and repeated rows pass through; an empty
    table gives no rows; other columns are not looked at, whatever their names. Work in the driver and the size of what
    is sent to tasks depend on the length of the vectors only.
    """
    good = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).where(usable(F.col("v")) & (F.size("v") > 0))
    length = F.size("v").alias("length")
    common = good.groupBy(length).count().orderBy(F.desc("count"), F.desc("length")).first()
    dims = common["length"] if common else 1
    good = good.where(F.size("v") == dims)
    found = fit(good, "v", dims, most)
    scaled = (found.vectors / found.deviations[:, None]).T if len(found.deviations) else np.zeros((dims, 0))
    n, sums = found.n, found.sums
    largest = max(map(abs, sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = whole(batch.column(1), dims)
            if n * float(np.abs(y).max()) + largest < EXACT:
                # n * y - sums, exact in doubles
                apart = n * y - np.array(sums, np.float64)
                exact = apart.astype(np.int64)
                if float(np.abs(apart).max()) ** 2 * dims < 2.0**62:
                    squares = (exact * exact).sum(axis=1).tolist()
                else:
                    squares = [sum(v * v for v in row) for row in exact.tolist()]
            else:
                exact = n * _ints(y) - np.array(sums, dtype=object)
                apart = exact.astype(np.float64)
                squares = [sum(v * v for v in row) for row in exact.tolist()]
            z = apart @ scaled
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([q if q < 1 << 63 else None for q in squares], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, max(1, z.shape[1]), dtype=np.int32))
                                          if z.shape[1] else pa.array(np.zeros(len(z) + 1, np.int32)), pa.array(z.ravel()))],
                names=["vec_id", "deviation", "z"])

    kind = df.schema[vec_id].dataType.simpleString()
    return written(good.mapInArrow(run, f"vec_id {kind}, deviation long, z array<double>")), found


def identity_error(whitened: DataFrame, components: int) -> float | None:
    """Largest absolute entry of the covariance of the whitened coordinates less the identity."""
    if not components:
        return None
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    z = [F.col("z")[i] for i in range(components)]
    row = whitened.agg(*[F.covar_pop(z[i], z[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    whitened, found = whiten(read(spark, sf, "embeddings"))
    error = identity_error(whitened, len(found.shares))
    shares = F.array(*map(F.lit, found.shares)) if found.shares else F.array(F.lit(0.0))
    return whitened.select("vec_id", "deviation", F.posexplode("z").alias("pos", "whitened")).select(
        "vec_id", (F.col("pos") + 1).cast("int").alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation",
        "whitened", shares[F.col("pos")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
