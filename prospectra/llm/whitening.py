"""Embeddings whitened by the eigenvectors of their exact integer scatter, found through its characteristic polynomial."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from decimal import Context, Decimal, localcontext

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospectra.llm.common import read, small_batches, written

COMPONENTS = 16
STEP = 64               # parts of one that an entry is counted in
FARTHEST = 2.0**52      # an entry counts at most so many parts, either way
OFFSET = 1_000_000      # added to every part count; shifts all vectors alike, so the scatter is taken without it
FIRST_PRIME = 2**31 - 1  # primes go down from here: products of two residues fit 63 bits
ROOT_BITS = 192         # binary places of an eigenvalue of the scatter
DIGITS = 120            # decimal digits of the null-space iteration
ROUNDS = 12             # inverse iterations at most; two are the rule

Polynomial = list[int]  # from the constant term upwards


def usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))


def parts(vector: str) -> Column:
    """Every entry in whole parts, without the offset."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * STEP, F.lit(FARTHEST)), F.lit(-FARTHEST))))


# The scatter ------------------------------------------------------------------------------------------------------------------

def exact_products(rows: np.ndarray) -> np.ndarray:
    """rows' * rows in whole numbers: through doubles while every sum is below 2^53, else through Python's integers."""
    most = int(np.abs(rows).max(initial=0))
    if most * most * len(rows) < 2**53:
        return (rows.T.astype(np.float64) @ rows).astype(np.int64).astype(object)
    big = rows.astype(object)
    return big.T @ big


def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's sums of products (i, j), of entries (i, -1) and of rows (-1, -1)."""
    products, sums, n = 0, 0, 0
    for batch in batches:
        rows = np.stack(batch["x"].to_list())
        products = products + exact_products(rows)
        sums = sums + rows.astype(object).sum(axis=0)
        n += len(rows)
    if n:
        d = len(sums)
        out = [(i, j, Decimal(int(products[i, j]))) for i in range(d) for j in range(i, d)]
        out += [(i, -1, Decimal(int(sums[i]))) for i in range(d)] + [(-1, -1, Decimal(n))]
        yield pd.DataFrame(out, columns=["i", "j", "v"])


def scatter(distinct: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S and n * (sum of x x') - S S', which is n squared times the covariance, all exact. What reaches the driver is
    bounded by the dimension."""
    n, sums, products = 0, [0] * d, np.zeros((d, d), object)
    for r in distinct.mapInPandas(partial_sums, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if r["i"] < 0:
            n = int(r["v"])
        elif r["j"] < 0:
            sums[r["i"]] = int(r["v"])
        else:
            products[r["i"], r["j"]] = products[r["j"], r["i"]] = int(r["v"])
    own = np.array(sums, object)
    return n, sums, n * products - np.outer(own, own)


# Its characteristic polynomial ------------------------------------------------------------------------------------------------

def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every number below 3 * 10^9."""
    if n < 11:
        return n in (2, 3, 5, 7)
    if any(n % p == 0 for p in (2, 3, 5, 7)):
        return False
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """Descending primes whose product is above twice the bound, so that signed numbers up to it are told apart."""
    found, product, p = [], 1, FIRST_PRIME
    while product <= 2 * bound:
        if is_prime(p):
            found.append(p)
            product *= p
        p -= 2
    return found


def coefficient_bound(matrix: np.ndarray) -> int:
    """No coefficient exceeds it: the eigenvalues are not negative and sum to the trace t, so their k-th elementary symmetric sum is at
    most C(d, k) (t / d)^k."""
    d, t = len(matrix), int(np.trace(matrix))
    return max(math.comb(d, k) * t**k // d**k + 1 for k in range(d + 1))


def hessenberg(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """A similar upper Hessenberg matrix for each prime: h is (primes, d, d), p (primes,)."""
    d, q = h.shape[1], p[:, None]
    for k in range(d - 2):
        for at in np.flatnonzero(h[:, k + 1, k] == 0):              # bring a pivot up, with the same swap of columns
            rows = np.flatnonzero(h[at, k + 2:, k])
            if len(rows):
                r = k + 2 + rows[0]
                h[at, [k + 1, r]] = h[at, [r, k + 1]]
                h[at][:, [k + 1, r]] = h[at][:, [r, k + 1]]
        inverse = np.array([pow(int(a), -1, int(m)) if a else 0 for a, m in zip(h[:, k + 1, k], p)], np.int64)
        factor = h[:, k + 2:, k] * inverse[:, None] % q
        h[:, k + 2:] = (h[:, k + 2:] - factor[:, :, None] * h[:, None, k + 1] % q[:, :, None]) % q[:, :, None]
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2:] * factor[:, None] % q[:, :, None]).sum(axis=2)) % q
    return h


def characteristic_residues(matrix: np.ndarray, primes: list[int]) -> np.ndarray:
    """det(x - matrix) modulo each prime, (primes, d + 1) from the constant term upwards."""
    d, p = len(matrix), np.array(primes, np.int64)
    h = hessenberg(np.stack([(matrix % m).astype(np.int64) for m in primes]), p)
    q = p[:, None]
    polynomials = np.zeros((len(p), d + 1, d + 1), np.int64)        # of the leading minors
    polynomials[:, 0, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros((len(p), d + 1), np.int64)
        new[:, 1:] = polynomials[:, k - 1, :-1]
        new = (new - h[:, k - 1, k - 1, None] * polynomials[:, k - 1] % q) % q
        below = np.ones(len(p), np.int64)
        for i in range(k - 1, 0, -1):
            below = below * h[:, i, i - 1] % p
            new = (new - (below * h[:, i - 1, k - 1] % p)[:, None] * polynomials[:, i - 1] % q) % q
        polynomials[:, k] = new
    return polynomials[:, d]


def characteristic(spark: SparkSession, matrix: np.ndarray) -> Polynomial:
    """det(x - matrix) for a whole, symmetric, positive semidefinite matrix: residues by Spark tasks that share out the primes, put
    together by Chinese remaindering."""
    primes = primes_for(coefficient_bound(matrix))
    cells = [[int(v) for v in row] for row in matrix]

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [int(m) for m in batch["p"]]
            yield pd.DataFrame({"p": own, "residues": characteristic_residues(np.array(cells, object), own).tolist()})

    dealt = spark.createDataFrame([(m,) for m in primes], "p long").repartition(max(1, len(primes) // 16), "p")
    by_prime = {r["p"]: r["residues"] for r in dealt.mapInPandas(reduced, "p long, residues array<long>").collect()}
    product = math.prod(primes)
    weights = [(product // m) * pow(product // m, -1, m) for m in primes]
    out = []
    for k in range(len(matrix) + 1):
        c = sum(w * by_prime[m][k] for w, m in zip(weights, primes)) % product
        out.append(c - product if 2 * c > product else c)
    return out


# Its roots --------------------------------------------------------------------------------------------------------------------

def shifted(c: Polynomial, a: int) -> Polynomial:
    """c(x + a)."""
    c = list(c)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += a * c[k + 1]
    return c


def roots_above(c: Polynomial, a: int) -> int:
    """How many roots, counted by multiplicity, are above a: where all roots are real, exactly the sign changes of c(x + a)."""
    signs = [v > 0 for v in shifted(c, a) if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def value(c: Polynomial, x: int) -> int:
    v = 0
    for k in reversed(c):
        v = v * x + k
    return v


def scaled(c: Polynomial, bits: int) -> Polynomial:
    """The polynomial whose roots are 2^bits times as large."""
    d = len(c) - 1
    return [v << bits * (d - k) for k, v in enumerate(c)]


def largest_roots(c: Polynomial, wanted: int, bits: int = ROOT_BITS) -> list[tuple[int, int]]:
    """(root * 2^bits rounded up, multiplicity) of the largest positive roots in falling order, until `wanted` roots are covered.

    Intervals are halved by exact counts until each holds one root, first at whole numbers, then at 2^-bits; roots that even those do not
    part count as one multiple root. A lone root is then narrowed by the polynomial's sign.
    """
    positive = roots_above(c, 0)
    top = 1 << max(1, -c[-2] if len(c) > 1 else 1).bit_length()                   # above the trace, so above every root
    fine = scaled(c, bits)
    found, stack = [], [(0, top, positive, 0, 0)]                                # (lo, hi] holds roots number above_hi + 1 .. above_lo
    while stack:
        lo, hi, above_lo, above_hi, scale = stack.pop()
        if above_lo == above_hi or above_hi >= wanted:
            continue
        if above_lo - above_hi == 1:
            found.append((narrowed(fine, lo << bits - scale, hi << bits - scale), 1))
        elif hi - lo == 1 and scale == bits:
            found.append((hi, above_lo - above_hi))
        elif hi - lo == 1:
            stack.append((lo << bits, hi << bits, above_lo, above_hi, bits))
        else:
            mid = (lo + hi) // 2
            above = roots_above(fine if scale else c, mid)
            stack += [(lo, mid, above_lo, above, scale), (mid, hi, above, above_hi, scale)]     # the upper half is next
    return found


def narrowed(c: Polynomial, lo: int, hi: int) -> int:
    """The end above the only root in (lo, hi]."""
    end = value(c, hi)
    if end == 0:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        v = value(c, mid)
        if v == 0:
            return mid
        lo, hi = (lo, mid) if (v > 0) == (end > 0) else (mid, hi)
    return hi


# Its vectors ------------------------------------------------------------------------------------------------------------------

def factored(a: np.ndarray, least: Decimal) -> tuple[np.ndarray, list[int]]:
    """LU in place with row swaps; a pivot that vanishes becomes `least`."""
    order = list(range(len(a)))
    for k in range(len(a)):
        r = max(range(k, len(a)), key=lambda i: abs(a[i, k]))
        if r != k:
            a[[k, r]] = a[[r, k]]
            order[k], order[r] = order[r], order[k]
        if abs(a[k, k]) < least:
            a[k, k] = least
        a[k + 1:, k] = a[k + 1:, k] / a[k, k]
        a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k], a[k, k + 1:])
    return a, order


def solved(lu: np.ndarray, order: list[int], b: np.ndarray) -> np.ndarray:
    x = b[order]
    for k in range(len(x)):
        x[k] -= lu[k, :k] @ x[:k] if k else 0
    for k in range(len(x) - 1, -1, -1):
        x[k] = (x[k] - (lu[k, k + 1:] @ x[k + 1:] if k + 1 < len(x) else 0)) / lu[k, k]
    return x


def null_vectors(matrix: np.ndarray, root: int, count: int, bits: int = ROOT_BITS) -> list[np.ndarray]:
    """`count` orthonormal vectors of the null space of matrix - root / 2^bits: inverse iteration from fixed random starts, many digits
    wide, until the residual is far below double precision. The largest entry of each is positive."""
    with localcontext(Context(prec=DIGITS)):
        whole = np.array([[Decimal(int(v)) for v in row] for row in matrix], object)
        size = max(np.trace(whole), Decimal(1))
        moved = whole.copy()
        shift = Decimal(root) / (1 << bits)
        for i in range(len(moved)):
            moved[i, i] -= shift
        lu, order = factored(moved, size.scaleb(10 - DIGITS))
        rng = random.Random(root)
        basis = [np.array([Decimal(rng.randrange(1, 1 << 30)) for _ in whole], object) for _ in range(count)]
        for _ in range(ROUNDS):
            new: list[np.ndarray] = []
            for v in basis:
                v = solved(lu, order, v)
                v = v / max(map(abs, v))
                for _ in range(2):
                    for u in new:
                        v = v - (u @ v) * u
                new.append(v / (v @ v).sqrt())
            basis = new
            if all(max(map(abs, whole @ v - shift * v)) < size * Decimal("1e-40") for v in basis):
                break
        return [v if max(v, key=abs) > 0 else -v for v in basis]


def components(spark: SparkSession, matrix: np.ndarray, wanted: int) -> list[tuple[float, np.ndarray]]:
    """(eigenvalue, unit eigenvector) of the `wanted` largest eigenvalues above zero, in falling order."""
    out = []
    for root, count in largest_roots(characteristic(spark, matrix), wanted):
        out += [(root / (1 << ROOT_BITS), v.astype(np.float64)) for v in null_vectors(matrix, root, count)]
    return out[:wanted]


# The embeddings ---------------------------------------------------------------------------------------------------------------

def deviations(xs: pd.Series, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, in whole numbers."""
    rows = np.stack(xs.to_list())
    if n * (2 * int(np.abs(rows).max()) + 1) + max(map(abs, sums)) < 2**62:
        return n * rows - np.array(sums, np.int64)
    return n * rows.astype(object) - np.array(sums, object)


def square_sums(rows: np.ndarray) -> list[int | None]:
    """Sums of squares; null where a sum is beyond a long."""
    if rows.dtype != object and int(np.abs(rows).max()) ** 2 * rows.shape[1] < 2**63:
        return (rows * rows).sum(axis=1).tolist()
    return [s if s < 2**63 else None for s in (sum(int(v) ** 2 for v in row) for row in rows)]


def projected(n: int, sums: list[int], axes: np.ndarray):
    """A column function: deviation, its decimal digits, and the whitened coordinates."""

    @F.pandas_udf("deviation long, whitened array<double>")
    def project(xs: pd.Series) -> pd.DataFrame:
        if not len(xs):
            return pd.DataFrame({"deviation": pd.Series(dtype="Int64"), "whitened": []})
        rows = deviations(xs, n, sums)
        return pd.DataFrame({"deviation": pd.array(square_sums(rows), dtype="Int64"), "whitened": list(rows.astype(np.float64) @ axes)})

    return project


def identity_error(distinct: DataFrame, n: int, sums: list[int], axes: np.ndarray) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity."""

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((axes.shape[1],) * 2)
        for batch in batches:
            z = deviations(batch["x"], n, sums).astype(np.float64) @ axes
            total += z.T @ z
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    cells = distinct.mapInPandas(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return float(cells.agg(F.max(F.abs(F.col("v") / n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))).first()[0])


def whiten(vectors: DataFrame, vector: str, keep: list[str], wanted: int = COMPONENTS) -> DataFrame:
    """`keep`, component, n, deviation, whitened, explained and identity_error of every usable row and component.

    Entries become whole parts (64 to one); the fit list is each distinct vector of parts once, a written table. Its scatter
    is summed exactly by tasks, and only numbers bounded by the dimension meet on the driver: the scatter, residues of
    its characteristic polynomial, eigenvectors. Rows with a null vector or a null or non-finite entry are left out, and so are vectors
    of another length than most have (of two equally common lengths the longer stands). Repeated rows and equal vectors are each
    returned and count once in the fit; a null in `keep` stays. Entries beyond 2^52 parts count as that. Eigenvalues of zero (fewer
    distinct vectors than components, constant dimensions) have no whitened coordinate and no row; an empty table, or one distinct
    vector, gives no rows. A deviation beyond a long is null. Other columns are not read, so their names may be any.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    schema = T.StructType([vectors.schema[c] for c in keep] + [T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType())]
                          + [T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")])
    rows = vectors.where(usable(vector)).select(F.struct(*keep).alias("kept"), parts(vector).alias("x"))
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None or common["d"] == 0:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == common["d"])
    distinct = written(rows.select("x").distinct())
    n, sums, matrix = scatter(distinct, common["d"])
    found = components(spark, matrix, wanted)
    if not found:
        return spark.createDataFrame([], schema)
    axes = np.stack([v / math.sqrt(e) for e, v in found], axis=1)
    share = F.array(*(F.lit(e / int(np.trace(matrix))) for e, _ in found))
    error = identity_error(distinct, n, sums, axes)
    return (rows.select("kept", projected(n, sums, axes)("x").alias("p"))
            .select("kept", F.col("p.deviation").alias("deviation"), F.posexplode("p.whitened").alias("at", "whitened"))
            .select("kept.*", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"), "embedding", ["vec_id"])
