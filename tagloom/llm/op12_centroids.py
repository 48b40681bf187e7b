"""Exact clustering of whole-number vectors around centroids, with Drake's adaptive bounds.

Each vector carries its centroid, an upper bound of the distance to it, lower
bounds of the distances to its `bounds` next centroids, in the order in which
they last stood, and one lower bound for all the others. When centroids move,
bounds move with them. A vector is left alone where its upper bound lies below
all lower bounds; else only the centroids before the first place from which all
bounds lie above it are measured, and where there is no such place, all of
them. Bounds are floating-point with SLACK to spare, every distance that
decides is a whole number, so ties and near ties are measured and never
guessed. After each round the number of bounds falls to what was needed.

A round is one job: it reads the vectors with their bounds, writes them anew
and adds, for each task and centroid, a row of sums, from which the next
centroids come. The driver holds centroids only. The table of a round is in the
shared folder and deleted after the next one is written.

Vectors count if they have exactly `size` components, none null, NaN or
infinite. Components are floor(scale * x), x as double, and have to lie within
+-LARGEST, else the job fails, as squared distances wouldn't fit 64 bits.
Repeated rows are all kept and counted. Rows with a null id count and are
clustered, but start no centroid while others are left; equal ids start
centroids in the order of their vectors. With fewer vectors than centroids
there are fewer centroids, and without any no rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, table

LARGEST = 1 << 27
#: More than rounding can add up to in the bounds of vectors within LARGEST.
SLACK = 1e-3

CLUSTERS, ROUNDS, SIZE, SCALE, SEED = 8, 10, 64, 1024, "3:"

_STATE = (
    "vec_id long, v binary, cluster int, upper double, near binary, low binary, rest double, distance long, "
    "sums array<long>, n long, needed int, measured long"
)


def kept(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and x, the whole-number components, of the vectors that count."""
    whole = F.col("embedding").cast("array<double>")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("e")).where(F.size("e") == size)
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return good.where(finite).select("vec_id", F.transform("e", lambda x: F.floor(x * scale)).alias("x"))


def seeds(rows: DataFrame, k: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The k vectors whose ids hash lowest, in that order."""
    key = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = rows.select(key.alias("key"), "x").orderBy(F.asc_nulls_last("key"), "x").limit(k).collect()
    return np.array([r["x"] for r in first], np.int64).reshape(len(first), -1 if first else 0)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of v to c, one centroid or one for each row."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


class Bounds:
    """What is known of a batch of vectors v about their centroids."""

    def __init__(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, low: np.ndarray, rest: np.ndarray) -> None:
        self.v, self.cluster, self.upper, self.near, self.low, self.rest = v, cluster, upper, near, low, rest
        self.needed, self.measured = 0, 0

    @classmethod
    def unknown(cls, v: np.ndarray, bounds: int) -> Bounds:
        n = len(v)
        return cls(v, np.zeros(n, np.int32), np.full(n, np.inf), np.zeros((n, bounds), np.int32), np.zeros((n, bounds)), np.zeros(n))

    def shrink(self, bounds: int) -> None:
        """Keeps the first bounds; what the others knew goes into the rest."""
        if bounds < self.near.shape[1]:
            self.rest = np.minimum(self.rest, self.low[:, bounds:].min(1))
            self.near, self.low = self.near[:, :bounds].copy(), self.low[:, :bounds].copy()

    def move(self, moves: np.ndarray) -> None:
        """Centroids have moved by so much."""
        self.upper = self.upper + moves[self.cluster]
        self.low = self.low - moves[self.near]
        self.rest = self.rest - moves.max()

    def _places(self, at: np.ndarray) -> np.ndarray:
        """The first place from which on all bounds certify that no centroid is as near; one more than the bounds if none does."""
        all_bounds = np.c_[self.low[at], self.rest[at]]
        from_here = np.minimum.accumulate(all_bounds[:, ::-1], axis=1)[:, ::-1]
        certain = self.upper[at, None] + SLACK < from_here
        return np.where(certain.any(1), certain.argmax(1), all_bounds.shape[1])

    def assign(self, centroids: np.ndarray) -> None:
        """Each vector to its nearest centroid, the smaller number where two are as near."""
        everyone = np.arange(len(self.v))
        open_ = everyone[self._places(everyone) > 0]
        if len(open_):  # the distance to its own centroid may settle it
            known = np.isfinite(self.upper[open_])
            self.upper[open_[known]] = np.sqrt(squared(self.v[open_[known]], centroids[self.cluster[open_[known]]]).astype(float))
            self.measured += int(known.sum())
        places = self._places(open_)
        bounds = self.near.shape[1]
        self.needed = max(self.needed, int(places[places <= bounds].max(initial=0)))
        for z in range(1, bounds + 1):
            at = open_[places == z]
            if len(at):
                self._sort(at, np.c_[self.cluster[at], self.near[at, :z]], centroids, z)
        at = open_[places > bounds]
        if len(at):
            self._sort(at, np.broadcast_to(np.arange(len(centroids), dtype=np.int32), (len(at), len(centroids))), centroids, bounds)

    def _sort(self, at: np.ndarray, numbers: np.ndarray, centroids: np.ndarray, z: int) -> None:
        """Measures the numbered centroids: the nearest becomes the centroid, the next z are kept, and what is left bounds the rest."""
        far = np.stack([squared(self.v[at], centroids[numbers[:, j]]) for j in range(numbers.shape[1])], 1)
        self.measured += far.size
        order = np.lexsort((numbers, far), axis=1)
        far, numbers = np.sqrt(np.take_along_axis(far, order, 1).astype(float)), np.take_along_axis(numbers, order, 1)
        have = min(z, numbers.shape[1] - 1)
        self.cluster[at], self.upper[at] = numbers[:, 0], far[:, 0]
        self.near[at, :have], self.low[at, :have] = numbers[:, 1 : have + 1], far[:, 1 : have + 1]
        self.low[at, have:z] = np.inf
        if numbers.shape[1] == len(centroids):
            self.rest[at] = far[:, have + 1] if numbers.shape[1] > have + 1 else np.inf


def _pass(rows: DataFrame, centroids: np.ndarray, moves: np.ndarray | None, bounds: int, last: bool) -> DataFrame:
    """Assigns once: rows with their bounds, and after them a task's sums for each centroid. moves: None at first, when rows hold x only."""
    k, size = centroids.shape
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("cluster", pa.int32()), ("upper", pa.float64()), ("near", pa.binary()), ("low", pa.binary()), ("rest", pa.float64()), ("distance", pa.int64()), ("sums", pa.list_(pa.int64())), ("n", pa.int64()), ("needed", pa.int32()), ("measured", pa.int64())])

    def packed(x: np.ndarray, kind: str) -> pa.Array:
        return pa.array([r.tobytes() for r in np.ascontiguousarray(x, kind)], pa.binary())

    def unpacked(column: pa.Array, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, needed, measured, inertia = np.zeros((k, size), np.int64), np.zeros(k, np.int64), 0, 0, [0] * k
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            c = dict(zip(batch.schema.names, batch.columns, strict=True))
            if moves is None:
                v = c["x"].flatten().to_numpy(zero_copy_only=False).reshape(n, size)
                if np.abs(v).max() > LARGEST:
                    raise ValueError(f"components beyond {LARGEST} have squared distances that don't fit 64 bits")
                b = Bounds.unknown(v, bounds)
            else:
                v = unpacked(c["v"], "<i4").astype(np.int64)
                b = Bounds(v, c["cluster"].to_numpy().copy(), c["upper"].to_numpy().copy(), unpacked(c["near"], "<i4").copy(), unpacked(c["low"], "<f8").copy(), c["rest"].to_numpy().copy())
                b.shrink(bounds)
                b.move(moves)
            b.assign(centroids)
            needed, measured = max(needed, b.needed), measured + b.measured
            np.add.at(sums, b.cluster, v)
            counts += np.bincount(b.cluster, minlength=k)
            none = lambda kind: pa.nulls(n, kind)
            if last:
                d = squared(v, centroids[b.cluster])
                for i in range(k):
                    inertia[i] += int(d[b.cluster == i].sum(dtype=object)) if (b.cluster == i).any() else 0
                own = [none(pa.binary()), pa.array(b.cluster), none(pa.float64()), none(pa.binary()), none(pa.binary()), none(pa.float64()), pa.array(d)]
            else:
                own = [packed(v, "<i4"), pa.array(b.cluster), pa.array(b.upper), packed(b.near, "<i4"), packed(b.low, "<f8"), pa.array(b.rest), none(pa.int64())]
            yield pa.RecordBatch.from_arrays([c["vec_id"], *own, none(pa.list_(pa.int64())), none(pa.int64()), none(pa.int32()), none(pa.int64())], schema=schema)
        full = np.flatnonzero(counts)
        if len(full):
            m = len(full)
            none = lambda kind: pa.nulls(m, kind)
            yield pa.RecordBatch.from_arrays(
                [none(pa.int64()), none(pa.binary()), pa.array(full, pa.int32()), none(pa.float64()), none(pa.binary()), none(pa.binary()), none(pa.float64()), pa.array([inertia[i] if last else None for i in full], pa.int64()), pa.array(sums[full].tolist(), pa.list_(pa.int64())), pa.array(counts[full]), pa.array([needed] * m, pa.int32()), pa.array([measured] + [0] * (m - 1), pa.int64())], schema=schema
            )

    return rows.mapInArrow(run, _STATE)


def _moved(summary: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The means of all vectors of each centroid, rounded down; the bounds that were needed; the distances that were measured. One row for each component comes to the driver."""
    parts = summary.select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    rows = parts.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
    new = centroids.copy()
    for r in rows:
        new[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    told = summary.agg(F.max("needed").alias("needed"), F.sum("measured").alias("measured")).first()
    return new, told["needed"] or 0, told["measured"] or 0


def cluster(rows: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS, bounds: int | None = None, log: list[dict] | None = None) -> DataFrame:
    """rows: vec_id, x. vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every row after so many rounds.

    bounds: at first, a quarter of the centroids and at least three. Rounds in which no centroid moves end the work, as all later ones are equal.
    log takes bounds needed and distances measured of each pass."""
    spark, k = rows.sparkSession, len(centroids)
    if not k:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    bounds = max(1, min(k - 1, max(3, k // 4) if bounds is None else bounds))
    moves, state, source = None, None, rows
    for _ in range(rounds):
        new_state = materialize(_pass(source, centroids, moves, bounds, False))
        if state is not None:
            release(state)
        state = new_state
        new, needed, measured = _moved(state.where("n IS NOT NULL"), centroids)
        if log is not None:
            log.append({"bounds": bounds, "needed": needed, "measured": measured})
        moves = np.sqrt(((new - centroids).astype(float) ** 2).sum(1))
        if not moves.any():
            break
        if source is not rows:  # at first all vectors are measured against all
            bounds = max(1, min(bounds, max(needed, -(-k // 8))))
        centroids, source = new, state.where("n IS NULL").select("vec_id", "v", "cluster", "upper", "near", "low", "rest")
    if state is not None:
        source = state.where("n IS NULL").select("vec_id", "v", "cluster", "upper", "near", "low", "rest")
    done = materialize(_pass(source, centroids, moves, bounds, True))
    if state is not None:
        release(state)
    by_cluster = {r["cluster"]: int(r["d"]) for r in done.where("n IS NOT NULL").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    told = spark.createDataFrame([(i, d, sum(by_cluster.values()), sha[i]) for i, d in by_cluster.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row for each centroid
    return done.where("n IS NULL").select("vec_id", "cluster", "distance").join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(table(spark, sf_dir, "embeddings"))
    return cluster(rows, seeds(rows))


def _oracle() -> str:
    near = "(SELECT vec_id, v, rid, arg_min(i, (d, i)) AS i, min(d) AS d FROM (SELECT a.vec_id, a.v, a.rid, c.i, list_sum(list_transform(list_zip(a.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept a, {c} c) GROUP BY ALL)"
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS HUGEINT)) AS v, row_number() OVER () AS rid FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS i, v FROM (SELECT v, sha256('{SEED}' || vec_id) AS h FROM kept ORDER BY h NULLS LAST, v LIMIT {CLUSTERS}))",
    ]
    for r in range(ROUNDS):
        steps += [
            f"a{r} AS MATERIALIZED {near.format(c=f'c{r}')}",
            f"s{r} AS (SELECT i, j, sum(x) AS s, count(*) AS n FROM (SELECT i, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{r}) GROUP BY i, j)",
            f"m{r} AS (SELECT i, list(CAST((s - ((s % n) + n) % n) // n AS HUGEINT) ORDER BY j) AS v FROM s{r} GROUP BY i)",
            f"c{r + 1} AS MATERIALIZED (SELECT c.i, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.i = c.i)",
        ]
    steps.append(f"final AS MATERIALIZED {near.format(c=f'c{ROUNDS}')}")
    return f"""WITH {", ".join(steps)}
SELECT f.vec_id, CAST(f.i AS INTEGER) AS cluster, CAST(f.d AS BIGINT) AS distance, CAST(sum(f.d) OVER (PARTITION BY f.i) AS BIGINT) AS cluster_inertia, CAST(sum(f.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM final f JOIN c{ROUNDS} c ON c.i = f.i"""


ORACLE_SQL = _oracle()
