"""Whitening of embeddings on the principal components of an exact integer scatter matrix.

Entries become integers, so the scatter matrix ``n^2 V`` of ``n`` vectors is a matrix of exact integers, whatever their
offset. Its characteristic polynomial is computed modulo many primes (Hessenberg form, one task per few primes) and put
together by Chinese remaindering. All its roots are real, so that Descartes' rule counts those above a point exactly:
bisection isolates every root, and exact signs refine it. Each component is the null vector of the matrix less its root,
by inverse iteration in high precision. The data is read by narrow passes; what meets on the driver is a few values for
each pair of dimensions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal, localcontext
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions

SCALE, COMPONENTS = 64, 32
#: Binary places of the roots, and digits of the components while they are computed.
PLACES, DIGITS = 64, 60
#: Rows that are multiplied at once.
ROWS = 4096


# Integers of a vector table


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, x array<double>): vectors without null or non-finite entries, as doubles. Vectors are of one size; where
    sizes differ, those of the most frequent size (of these the largest) take part. Empty vectors don't."""
    x = F.col(embedding).cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), x.alias("x")).where(x.isNotNull() & (F.size(x) > 0) & ~odd)
    size = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("x") == (size["d"] if size else 0))


def _integers(column: pa.Array, d: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a batch."""
    own = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
    if np.abs(own).max(initial=0) >= 2.0**62:
        raise OverflowError("an entry does not fit 64 bits")
    return own.astype(np.int64)


def _exact_products(y: np.ndarray) -> np.ndarray:
    """y^T y in exact integers."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 1 << 53:  # sums of products that doubles hold exactly
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    if most * most * len(y) < 1 << 62:
        return y.T @ y
    return y.astype(object).T @ y.astype(object)


def _sums(rows: DataFrame, d: int, count: int, per_batch: Callable[[np.ndarray], list]) -> list[int]:
    """Exact totals of ``count`` integers that every block of rows gives, added up on the map side first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * count
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = _integers(batch.slice(at, ROWS).column(0), d, SCALE)
                total = [a + int(b) for a, b in zip(total, per_batch(y))]
        yield pa.RecordBatch.from_arrays([pa.array(range(count), pa.int32()), pa.array(map(str, total), pa.string())], ["cell", "v"])

    cells = rows.select("x").mapInArrow(run, "cell int, v string")  # as text, since parts may exceed 64 bits
    got = cells.groupBy("cell").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    if any(r["v"] is None for r in got):
        raise OverflowError("a sum of products does not fit 38 digits")
    totals = {r["cell"]: int(r["v"]) for r in got}
    return [totals.get(i, 0) for i in range(count)]


def scatter(rows: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(n, sums of floor(64 c), centre, matrix): ``matrix`` is the exact n^2 V as Python integers. Products are of entries
    less ``centre``, the means rounded."""
    n, *sums = _sums(rows, d, d + 1, lambda y: [len(y), *y.sum(axis=0, dtype=np.int64 if np.abs(y).max(initial=0) < 2**40 else object)])
    if not n:
        return 0, np.zeros(d, object), np.zeros(d, np.int64), np.zeros((d, d), object)
    centre = np.array([round(s / n) if abs(s) < 1 << 50 else s // n for s in sums], np.int64)
    up = np.triu_indices(d)
    flat = _sums(rows, d, len(up[0]), lambda y: _exact_products(y - centre)[up].tolist())
    left = np.array([s - n * int(c) for s, c in zip(sums, centre)], object)
    matrix = np.zeros((d, d), object)
    matrix[up] = flat
    matrix = matrix + np.triu(matrix, 1).T
    return n, np.array(sums, object), centre, n * matrix - np.outer(left, left)


# The characteristic polynomial


def primes_below(top: int, count: int) -> list[int]:
    """The largest primes below ``top``, in falling order."""

    def prime(x: int) -> bool:
        s = ((x - 1) & -(x - 1)).bit_length() - 1
        for a in (2, 3, 5, 7):  # enough below 3.2e9
            v = pow(a, (x - 1) >> s, x)
            if v not in (1, x - 1) and all((v := v * v % x) != x - 1 for _ in range(s - 1)):
                return False
        return True

    out, x = [], top - 1 | 1
    while len(out) < count:
        if prime(x):
            out.append(x)
        x -= 2
    return out


def residue_polynomial(matrix: np.ndarray, p: int) -> list[int]:
    """The coefficients of det(x - matrix) modulo the prime ``p`` < 2^31, constant first: by similarity to Hessenberg form,
    then by the recurrence over its leading blocks."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for k in range(1, d - 1):
        some = np.flatnonzero(h[k:, k - 1])
        if not len(some):
            continue
        i = k + int(some[0])
        if i != k:
            h[[k, i]] = h[[i, k]]
            h[:, [k, i]] = h[:, [i, k]]
        u = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - u[:, None] * h[k] % p) % p
        add = np.zeros(d, np.int64)
        for part in range(0, len(u), 1024):  # each product is below p
            add = (add + (h[:, k + 1 + part : k + 1 + part + 1024] * u[part : part + 1024] % p).sum(axis=1)) % p
        h[:, k] = (h[:, k] + add) % p
    polys = [np.array([1], np.int64)]
    for k in range(d):
        new = np.zeros(k + 2, np.int64)
        new[1:] = polys[k]
        new[:-1] = (new[:-1] - int(h[k, k]) * polys[k]) % p
        t = 1
        for i in range(k - 1, -1, -1):
            t = t * int(h[i + 1, i]) % p
            if not t:
                break
            new[: i + 1] = (new[: i + 1] - t * int(h[i, k]) % p * polys[i]) % p
        polys.append(new)
    return polys[d].tolist()


def _in_tasks(spark: SparkSession, items: list, work: Callable[[object], list[str]]) -> dict:
    """{item: texts} of a function of some numbers, a few of them a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()), pa.array([work(x)], pa.list_(pa.string()))], ["item", "out"])

    n = max(1, min(len(items), shuffle_partitions(spark)))
    told = spark.createDataFrame([(x,) for x in items], "item long").repartition(n)
    return {r["item"]: r["out"] for r in told.mapInArrow(run, "item long, out array<string>").collect()}


def characteristic(matrix: np.ndarray, spark: SparkSession | None = None) -> list[int]:
    """The exact coefficients of det(x - matrix), constant first, of a positive semidefinite integer matrix. Its k-th
    coefficient is at most C(d, k) (trace / d)^k; primes are taken until their product exceeds twice any of these."""
    d, trace = len(matrix), int(np.trace(matrix))
    bits = d + d * max(1, (trace // d + 1).bit_length()) + 2
    primes = primes_below(1 << 31, bits // 30 + 1)
    if spark is None:
        found = {p: residue_polynomial(matrix, p) for p in primes}
    else:
        found = _in_tasks(spark, primes, lambda p: [str(c) for c in residue_polynomial(matrix, p)])
    product = math.prod(primes)
    weights = [(product // p) * pow(product // p, -1, p) for p in primes]
    out = []
    for k in range(d + 1):
        c = sum(w * int(found[p][k]) for p, w in zip(primes, weights)) % product
        out.append(c - product if 2 * c > product else c)
    return out


# Its roots


def _primitive(a: list[int]) -> list[int]:
    while a and not a[-1]:
        a = a[:-1]
    g = reduce(math.gcd, a, 0) or 1
    return [c // g for c in a]


def _divided(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Quotient and remainder of polynomials, up to constant factors."""
    a, q = list(a), [0] * max(0, len(a) - len(b) + 1)
    while len(a) >= len(b):
        lead, at = a[-1], len(a) - len(b)
        q, a = [c * b[-1] for c in q], [c * b[-1] for c in a]
        q[at] += lead
        a = [c - lead * b[i - at] if i >= at else c for i, c in enumerate(a)][:-1]
        while a and not a[-1]:
            a = a[:-1]
    return _primitive(q), _primitive(a)


def _derivative(a: list[int]) -> list[int]:
    return [i * c for i, c in enumerate(a)][1:]


def _common(a: list[int], b: list[int]) -> list[int]:
    a, b = _primitive(a), _primitive(b)
    while b:
        a, b = b, _divided(a, b)[1]
    return a


def simple_parts(poly: list[int]) -> list[tuple[list[int], int]]:
    """(factor, multiplicity): factors without repeated roots."""
    p = 2_147_483_629
    if len(poly) > 1 and poly[-1] % p and _coprime(poly, _derivative(poly), p):
        return [(poly, 1)]
    rest, parts, m = _common(poly, _derivative(poly)), [], 1
    once = _divided(poly, rest)[0]
    while len(once) > 1:
        more = _common(once, rest)
        own = _divided(once, more)[0]
        if len(own) > 1:
            parts.append((own, m))
        once, rest, m = more, _divided(rest, more)[0], m + 1
    return parts


def _coprime(a: list[int], b: list[int], p: int) -> bool:
    """Whether two polynomials have no common factor modulo a prime; then they have none at all."""
    a, b = [c % p for c in a], [c % p for c in b]
    while True:
        while b and not b[-1]:
            b.pop()
        if not b:
            return len(a) == 1
        inverse = pow(b[-1], -1, p)
        while len(a) >= len(b):
            t = a[-1] * inverse % p
            at = len(a) - len(b)
            for i, c in enumerate(b):
                a[at + i] = (a[at + i] - t * c) % p
            a.pop()
        a, b = b, a


def roots_above(poly: list[int], x: int) -> int:
    """How many roots of a polynomial with real roots only are above ``x``: the changes of sign of poly(x + y)."""
    c = list(poly)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += x * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def positive_roots(poly: list[int], top: int, places: int = PLACES, most: int | None = None) -> list[tuple[int, int]]:
    """(root, multiplicity) of the positive roots, at most ``top``, in falling order (the first ``most``, with repeats), in
    units of 2^-places: the root is in (r - 1, r]."""
    found: list[tuple[int, int]] = []
    while poly and not poly[0]:
        poly = poly[1:]
    for part, m in simple_parts(poly):
        d = len(part) - 1
        scaled = [c << places * (d - k) for k, c in enumerate(part)]
        cells = [(0, (top << places) + 1, roots_above(scaled, 0))]  # (low, high, roots in (low, high])
        while cells:
            low, high, k = cells.pop()
            if not k:
                continue
            if high - low == 1:
                found.append((high, m * k))
            elif k == 1:
                found.append((_refined(scaled, low, high), m))
            else:
                mid = (low + high) // 2
                upper = roots_above(scaled, mid) - roots_above(scaled, high)
                cells += [(low, mid, k - upper), (mid, high, upper)]
    out, taken = [], 0
    for r, m in sorted(found, reverse=True):
        if most is not None and taken >= most:
            break
        out.append((r, m))
        taken += m
    return out


def _refined(poly: list[int], low: int, high: int) -> int:
    """The only root in (low, high], by exact signs."""

    def sign(x: int) -> int:
        v = reduce(lambda t, c: t * x + c, reversed(poly))
        return (v > 0) - (v < 0)

    top = sign(high)
    if not top:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        s = sign(mid)
        if not s:
            return mid
        low, high = (low, mid) if s == top else (mid, high)
    return high


# Its components


def null_vectors(matrix: np.ndarray, root: int, count: int, places: int = PLACES) -> list[list[Decimal]]:
    """``count`` orthonormal vectors that the matrix multiplies by root / 2^places: inverse iteration with one
    factorisation; each vector is kept apart from those before it. The entry of largest size is positive."""
    d = len(matrix)
    with localcontext() as c:
        c.prec = DIGITS + max(0, len(str(int(np.abs(matrix).max()))) - 20)
        a = np.array([[Decimal(int(v)) for v in row] for row in matrix], object)
        tiny = Decimal(1) / (1 << places + 20)
        for i in range(d):
            a[i, i] -= Decimal(root) / (1 << places) + tiny
        swaps, scale = [], max(abs(a).max(), Decimal(1))
        for k in range(d):
            i = k + max(range(d - k), key=lambda t: abs(a[k + t, k]))
            swaps.append(i)
            if i != k:
                a[[k, i]] = a[[i, k]]
            if abs(a[k, k]) < scale.scaleb(-c.prec):
                a[k, k] = scale.scaleb(-c.prec)
            if k + 1 < d:
                a[k + 1 :, k] /= a[k, k]
                a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
        found: list[np.ndarray] = []
        for nth in range(count):
            v = np.array([Decimal(1) + Decimal((7919 * (i + 1) * (nth + 1)) % 1009) / 1009 for i in range(d)], object)
            for _ in range(4):
                for w in found:
                    v = v - w * (v @ w)
                v = v / (v @ v).sqrt()
                for k in range(d):
                    v[[k, swaps[k]]] = v[[swaps[k], k]] if swaps[k] != k else v[[k, k]]
                    v[k + 1 :] -= a[k + 1 :, k] * v[k]
                for k in range(d - 1, -1, -1):
                    v[k] = v[k] / a[k, k]
                    v[:k] -= a[:k, k] * v[k]
            for w in found:
                v = v - w * (v @ w)
            v = v / (v @ v).sqrt()
            found.append(v if v[int(np.argmax([abs(x) for x in v]))] > 0 else -v)
        return [[+x for x in v] for v in found]


# The whole


class Whitening:
    """A fitted whitening: n, sums and centre of the integers, components (rows), eigenvalues and their shares."""

    def __init__(self, n: int, sums: np.ndarray, centre: np.ndarray, components: np.ndarray, values: list[float], shares: list[float]):
        self.n, self.sums, self.centre, self.components, self.values, self.shares = n, sums, centre, components, values, shares
        #: Means less the centre, correctly rounded.
        self.means = np.array([float(Decimal(int(s) - n * int(c)) / n) if n else 0.0 for s, c in zip(sums, centre)])

    def whiten(self, y: np.ndarray) -> np.ndarray:
        """Integers floor(64 c) of some rows -> their whitened values, a column for each component."""
        return ((y - self.centre) - self.means) @ self.components.T / np.sqrt(np.array(self.values))

    def deviations(self, y: np.ndarray) -> list[int]:
        """The exact squared distance of each row to the mean, in units of n."""
        rest = [int(s) - self.n * int(c) for s, c in zip(self.sums, self.centre)]
        z = y - self.centre
        most = self.n * int(np.abs(z).max(initial=0)) + max(map(abs, rest), default=0)
        if most * most * y.shape[1] < 1 << 63:
            return ((self.n * z - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        return ((self.n * z.astype(object) - np.array(rest, object)) ** 2).sum(axis=1).tolist()


def fit(rows: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """A whitening by all rows of ``usable``; None without rows. Only components of a positive eigenvalue count."""
    spark = rows.sparkSession
    one = rows.first()
    if one is None:
        return None
    n, sums, centre, matrix = scatter(rows, len(one["x"]))
    trace = int(np.trace(matrix))
    if not trace:
        return Whitening(n, sums, centre, np.zeros((0, len(sums))), [], [])
    roots = positive_roots(characteristic(matrix, spark), trace, most=most)
    times = dict(roots)
    vectors = _in_tasks(spark, list(range(len(roots))), lambda i: [str(x) for v in null_vectors(matrix, roots[i][0], times[roots[i][0]]) for x in v])
    components, values, shares = [], [], []
    for i, (root, m) in enumerate(roots):
        parts = np.array([float(x) for x in vectors[i]]).reshape(m, -1)
        components += list(parts)
        values += [float(Decimal(root) / (1 << PLACES) / n / n)] * m
        shares += [float(Decimal(root) / (1 << PLACES) / trace)] * m
    return Whitening(n, sums, centre, np.array(components)[:most], values[:most], shares[:most])


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity. Each task gives the sums and centred
    products of its rows; these are put together with the products of their means."""
    d, k = len(model.sums), len(model.values)
    up = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros(len(up[0]))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                w = model.whiten(_integers(batch.slice(at, ROWS).column(0), d, SCALE))
                sums += w.sum(axis=0)  # the fitted mean is taken off, so sums stay near 0
                products += (w.T @ w)[up]
        yield pa.RecordBatch.from_arrays([pa.array(range(k + len(products)), pa.int32()), pa.array(np.concatenate([sums, products]))], ["cell", "v"])

    got = dict(rows.select("x").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v")).toArrow().to_pandas().itertuples(index=False))
    means = np.array([got[i] for i in range(k)]) / model.n
    covariance = np.array([got[k + i] for i in range(len(up[0]))]) / model.n - means[up[0]] * means[up[1]]
    return float(np.abs(covariance - (up[0] == up[1])).max())


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component (from 1, by falling eigenvalue), n, deviation,
    whitened, explained, identity_error.

    Entries count as floor(64 c). Vectors that are null, empty, or hold null or non-finite entries take no part, nor do
    those of another size than most; an entry or deviation that does not fit 64 bits is an error. There are as many
    components as positive eigenvalues, up to ``most``: none, and no rows, for no vectors or equal vectors only. Components
    of equal eigenvalues are some orthonormal basis. Repeated rows get rows each, a null vec_id stays null, other columns
    aren't read.
    """
    rows = Scratch(vectors.sparkSession).keep(usable(vectors, vec_id, embedding), "vectors")
    kind = vectors.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, most)
    if model is None or not model.values:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model)
    d, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                y, m = _integers(part.column(1), d, SCALE), part.num_rows
                ids = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                        pa.array(np.full(m * k, model.n), pa.int64()),
                        pa.array(np.repeat(np.array(model.deviations(y), object), k).tolist(), pa.int64()),
                        pa.array(model.whiten(y).ravel()),
                        pa.array(np.tile(model.shares, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
