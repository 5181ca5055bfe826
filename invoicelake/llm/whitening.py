"""Whitening of embeddings by principal components from the exact characteristic polynomial.

Every entry c becomes the integer floor(1024 c) + 100000. The scatter of these integers is added up exactly, so
A = n * sum(x x') - S S' is an integer matrix: n * n times the covariance. Its eigenvalues and eigenvectors then come without
any loss before the last step:

1. The characteristic polynomial of A modulo many 31-bit primes, each by reduction to Hessenberg form and the recurrence of
   its leading minors. The primes are tasks of a Spark job.
2. Chinese remaindering gives the integer coefficients. The number of primes follows from the bound C(d, k) (trace / d)^k on
   the k-th coefficient, which holds as no eigenvalue is negative.
3. All roots are real, so the number of roots above t is exactly the number of sign changes in the coefficients of p(x + t)
   (Descartes). Bisection with integers, on roots scaled by 2^FRACTION_BITS, isolates the largest roots; an isolated one is
   narrowed by the sign of p alone. Roots that are equal in all these bits count as one root of that multiplicity.
4. A unit vector of the null space of A - root, by inverse iteration with decimal numbers of a precision taken from the size
   of the roots. A multiple root iterates as many vectors at once and orthogonalises them.

The scatter is summed in the tasks (floating-point products below 2^52, exact, or Python integers beyond) and over the tasks
as limbs of 40 bits, so nothing overflows. What reaches the driver depends on the dimension d alone: d * d sums and d
coefficients per prime. Meant for dimensions up to about a thousand.

Result: one row per vector and component 1 to 8 (or d): vec_id, component, n, deviation, whitened, explained, identity_error,
deviation_exact.

Cases: rows with a null vector or with null, NaN or infinite entries are left out, and so are entries whose integer does not
fit a long; of vectors of different lengths the most frequent length counts (of equally frequent ones the longer), the
others are left out. Fewer different vectors than components leave eigenvalues of exactly zero: such components have
null in `whitened` and 0 in `explained`, and do not enter identity_error (0 without any component). `deviation` is null if
it passes the range of a long; deviation_exact has its digits at any size. Equal rows and null ids give rows each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from invoicelake.llm.words import Batches, Mapper, mapped
from invoicelake.session import staged

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
FRACTION_BITS = 64
LIMB = 40
LIMBS = 4
#: The largest 1024 * c whose integer plus SHIFT is a long, and the smallest.
TOP, BOTTOM = float(2**63 - 1024 * 99), -float(2**63)
EXACT = 1 << 52  # sums of products below it are exact in floating point


# The integer table --------------------------------------------------------------------------------------------------

def _usable(vector: Column) -> Column:
    scaled = lambda c: c.cast("double") * SCALE
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (scaled(c) <= TOP) & (scaled(c) >= BOTTOM))


def integers(vectors: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id and z = floor(1024 c) per entry, for the rows that count; their dimension. The shift by 100000 changes no deviation."""
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    rows = vectors.where(F.coalesce(_usable(F.col(vector)), F.lit(False))).select("vec_id", whole.alias("z"))
    most = rows.groupBy(F.size("z").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = most[0]["d"] if most else 0
    return rows.where(F.size("z") == d), d


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _products(x: np.ndarray) -> np.ndarray:
    """The exact x' x as Python integers."""
    top = max(1, int(x.max()), -int(x.min()))
    if top * top > EXACT:
        x = x.astype(object)
        return x.T @ x
    block = EXACT // (top * top)
    out = np.zeros((x.shape[1], x.shape[1]), object)
    for i in range(0, len(x), block):
        part = x[i:i + block].astype(np.float64)
        out += (part.T @ part).astype(np.int64)
    return out


def _scatter(d: int) -> Mapper:
    """Sums of products of one partition, with a column of ones: row and column d hold the sums and the number of rows."""
    upper = np.triu_indices(d + 1)

    def run(batches: Batches) -> Batches:
        total = np.zeros((d + 1, d + 1), object)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, d)
                total += _products(np.hstack([x, np.ones((len(x), 1), np.int64)]))
        limbs, rest = [], total[upper]
        for _ in range(LIMBS - 1):
            limbs.append(rest & ((1 << LIMB) - 1))
            rest = rest >> LIMB
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)) for i in upper] + [pa.array(v.tolist(), pa.int64()) for v in (*limbs, rest)],
                                         ["i", "j", *[f"l{k}" for k in range(LIMBS)]])
    return run


def scatter(rows: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """Number of rows, sums S of z per dimension, and A = n * sum(z z') - S S', all exact."""
    kind = "i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS))
    sums = mapped(rows, _scatter(d), kind).groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)])
    full = np.zeros((d + 1, d + 1), object)
    for r in sums.collect():
        full[r["i"], r["j"]] = full[r["j"], r["i"]] = sum(r[f"l{k}"] << (LIMB * k) for k in range(LIMBS))
    n, s = full[d, d], full[:d, d]
    return int(n), s.tolist(), n * full[:d, :d] - np.outer(s, s)


# The characteristic polynomial --------------------------------------------------------------------------------------

def primes() -> Iterator[int]:
    """Primes below 2^31, falling (Miller-Rabin with bases that are enough for 32 bits)."""
    for p in range((1 << 31) - 1, 1 << 30, -2):
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        if all(pow(b, odd, p) == 1 or any(pow(b, odd << k, p) == p - 1 for k in range(twos)) for b in (2, 3, 5, 7)):
            yield p


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A similar matrix modulo p with zeros below the first subdiagonal."""
    h = a.copy()
    for m in range(1, len(h) - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        factor = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - factor[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * factor % p).sum(axis=1)) % p
    return h


def polynomial_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - a) modulo p, the constant first."""
    h = hessenberg(a, p)
    d = len(h)
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        factor, chain = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):  # h[i, k - 1] times the subdiagonal between
            factor[i] = int(h[i, k - 1]) * chain % p
            chain = chain * int(h[i, i - 1]) % p if i else chain
        minors[k, 1:] = minors[k - 1, :-1]
        minors[k] = (minors[k] - (minors[:k] * factor[:, None] % p).sum(axis=0)) % p
    return minors[d]


def needed_primes(a: np.ndarray) -> list[int]:
    """Enough primes to tell the coefficients, signs included."""
    d, trace = len(a), int(np.trace(a))
    mean = trace // d + 1
    bound, product, found = 2 * max(comb(d, k) * mean**k for k in range(d + 1)) + 1, 1, []
    for p in primes():
        if product > bound:
            return found
        found.append(p)
        product *= p
    raise ValueError("the matrix needs more primes than there are below 2^31")


def characteristic_polynomial(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Coefficients of det(x - a) over the integers, the constant first; the primes are dealt over Spark tasks."""
    moduli = needed_primes(a)
    entries = spark.sparkContext.broadcast(a)
    tasks = min(len(moduli), max(1, spark.sparkContext.defaultParallelism))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            own = [moduli[k] for k in batch.column(0).to_pylist()]
            rest = [polynomial_mod((entries.value % p).astype(np.int64), p).tolist() for p in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(rest, pa.list_(pa.int64()))], ["p", "c"])

    rows = sorted((r["p"], r["c"]) for r in mapped(spark.range(0, len(moduli), 1, tasks), run, "p long, c array<long>").collect())
    entries.destroy()
    value, product = np.zeros(len(a) + 1, object), 1
    for p, rest in rows:
        value = value + product * ((np.array(rest, object) - value) * pow(product, -1, p) % p)
        product *= p
    return [int(v - product if 2 * v > product else v) for v in value]


# Roots and null spaces ----------------------------------------------------------------------------------------------

def roots_above(c: list[int], t: int) -> int:
    """The number of roots above t of a polynomial with real roots only, each as often as it is one."""
    c = list(c)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += t * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(c: list[int], t: int) -> int:
    value = 0
    for x in reversed(c):
        value = value * t + x
    return (value > 0) - (value < 0)


def largest_roots(c: list[int], count: int, top: int, bits: int = FRACTION_BITS) -> list[tuple[int, int]]:
    """(root * 2^bits rounded up, multiplicity) of the largest roots until `count` are found, falling. No root is negative or above `top`."""
    d = len(c) - 1
    scaled = [x << (bits * (d - k)) for k, x in enumerate(c)]
    found: list[tuple[int, int]] = []
    stack = [(-1, top << bits, d, 0)]  # roots lie in (low, high]; this many are above low, and above high
    while stack and sum(m for _, m in found) < count:
        low, high, over_low, over_high = stack.pop()
        inside = over_low - over_high
        if inside == 1:
            beyond = 1 if over_high % 2 == 0 else -1  # sign of the polynomial just above the root
            while high - low > 1:
                middle = (low + high) // 2
                if _sign(scaled, middle) == beyond or _sign(scaled, middle) == 0:
                    high = middle
                else:
                    low = middle
        if high - low == 1:
            found.append((high, inside))
            continue
        middle = (low + high) // 2
        over = roots_above(scaled, middle)
        if over_low > over:
            stack.append((low, middle, over_low, over))
        if over > over_high:
            stack.append((middle, high, over, over_high))
    return found


def _solver(a: np.ndarray, root: Decimal, tiny: Decimal):
    """Solves (a - root) x = b by elimination with row exchange; a pivot of zero counts as tiny."""
    m = a.copy()
    d = len(m)
    m[np.arange(d), np.arange(d)] -= root
    order = list(range(d))
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(m[i, k]))
        if best != k:
            m[[k, best]] = m[[best, k]]
            order[k], order[best] = order[best], order[k]
        if m[k, k] == 0:
            m[k, k] = tiny
        if k + 1 < d:
            m[k + 1:, k] = m[k + 1:, k] / m[k, k]
            m[k + 1:, k + 1:] -= np.outer(m[k + 1:, k], m[k, k + 1:])

    def solve(b: np.ndarray) -> np.ndarray:
        x = b[order].copy()
        for k in range(d):
            x[k] -= m[k, :k].dot(x[:k]) if k else 0
        for k in range(d - 1, -1, -1):
            x[k] = (x[k] - (m[k, k + 1:].dot(x[k + 1:]) if k + 1 < d else 0)) / m[k, k]
        return x
    return solve


def _orthonormal(vectors: list[np.ndarray]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for v in vectors:
        for _ in range(2):
            for u in out:
                v = v - u * v.dot(u)
        out.append(v / v.dot(v).sqrt())
    return out


def null_vectors(a: np.ndarray, root: tuple[int, int], bits: int = FRACTION_BITS, rounds: int = 3) -> np.ndarray:
    """Orthonormal rows that a maps to the root times themselves, as many as its multiplicity."""
    scaled, multiplicity = root
    d = len(a)
    with localcontext() as context:
        context.prec = 40 + len(str(int(np.trace(a)))) + int(bits * 0.61)
        exact = np.array([[Decimal(int(v)) for v in row] for row in a], object)
        value = Decimal(scaled) / Decimal(1 << bits)
        solve = _solver(exact, value, Decimal(10) ** -context.prec)
        seed = [(7 * k * k + 3 * k + 1) % 1009 for k in range(1, d * multiplicity + 1)]
        vectors = [np.array([Decimal(s + 1) for s in seed[i * d:(i + 1) * d]], object) for i in range(multiplicity)]
        for _ in range(rounds):
            vectors = _orthonormal([solve(v) for v in _orthonormal(vectors)])
        return np.array([[float(x) for x in v] for v in vectors])


def principal(spark: SparkSession, a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest non-zero eigenvalues of a positive semidefinite integer matrix, at most `count`, and unit rows for them."""
    trace = int(np.trace(a))
    if not trace:
        return np.zeros(0), np.zeros((0, len(a)))
    c = characteristic_polynomial(spark, a)
    if c[-2] != -trace:
        raise ArithmeticError("the characteristic polynomial does not have the trace")
    zeros = next(k for k, x in enumerate(c) if x)  # roots that are exactly zero
    found = largest_roots(c[zeros:], min(count, len(a) - zeros), trace)
    values, vectors = [], []
    for root in found:
        values += [float(Decimal(root[0]) / Decimal(1 << FRACTION_BITS))] * root[1]
        vectors.append(null_vectors(a, root))
    return np.array(values)[:count], np.vstack(vectors)[:count]


# Whitening ----------------------------------------------------------------------------------------------------------

def _whiten(n: int, s: list[int], d: int, values: np.ndarray, vectors: np.ndarray, count: int) -> Mapper:
    scaled = (vectors / np.sqrt(values)[:, None]).T if len(values) else np.zeros((d, 0))
    sums = np.array(s, object)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, d)
            top = max(1, int(x.max()), -int(x.min())) * n + max(abs(v) for v in s)
            if top * top * d < 1 << 63:
                y = n * x - sums.astype(np.int64)
                deviation = (y * y).sum(axis=1).tolist()
            else:
                y = n * x.astype(object) - sums
                deviation = (y * y).sum(axis=1).tolist()
            w = y.astype(np.float64) @ scaled
            rows = [[*row, *[None] * (count - len(row))] for row in w.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v if v < 1 << 63 else None for v in deviation], pa.int64()), pa.array(list(map(str, deviation))),
                                              pa.array(rows, pa.list_(pa.float64()))], ["vec_id", "deviation", "deviation_exact", "w"])
    return run


def identity_error(whitened: DataFrame, rank: int) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity; they are centred first."""
    if not rank:
        return 0.0
    w = [F.col("w")[k] for k in range(rank)]
    means = whitened.agg(*[F.avg(x).alias(f"m{k}") for k, x in enumerate(w)]).first()
    pairs = [(i, j) for i in range(rank) for j in range(i, rank)]
    found = whitened.agg(*[F.avg((w[i] - means[i]) * (w[j] - means[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))


def whitened(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The whitened components of every vector that counts, one row each."""
    spark = vectors.sparkSession
    rows, d = integers(vectors, vector)
    rows = staged(rows, "integers")
    kind = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation long, deviation_exact string, w array<double>"
    count = min(components, d)
    if d:
        n, s, a = scatter(rows, d)
        values, axes = principal(spark, a, count)
        out = staged(mapped(rows, _whiten(n, s, d, values, axes, count), kind), "whitened")
        error, trace = identity_error(out, len(values)), float(int(np.trace(a)))
    else:
        n, values, out, error, trace = 0, np.zeros(0), spark.createDataFrame([], kind), 0.0, 1.0
    share = F.array(*[F.lit(float(v / trace)) for v in values], *[F.lit(0.0)] * (count - len(values)), F.lit(0.0))
    return out.select("vec_id", "deviation", "deviation_exact", F.posexplode("w").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("k") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"), "deviation_exact")
