"""Centroid clustering (k-means in integers) over a vector-approximation file.

Vectors become integers, and each component a cell of few bits, whose bounds are cut from
the mean and spread of its dimension over all rows (the outer cells end at its least and
greatest value, so no vector lies outside).  For each centroid and dimension a lookup table
tells how near and how far a cell's members can be, so the sums over the dimensions bound a
vector's distance; for the rows whose intervals overlap, like tables for pairs of centroids
bound by how much the one is nearer than the other.  A round reads the approximations alone;
where one centroid is left, it is taken.  Full vectors are fetched only where several are, and
where a vector changed its cluster: sums of clusters are carried on from round to round by
what came and what left, in exact integers.

Full vectors are written once, bucketed by row number, so that fetching shuffles only the row
numbers asked for.  The first and the last pass read all vectors (sums and distances need
them), and use the bounds to compute distances to the centroids in question only.  What is
sent to the driver is of the size of the centroids.

Defined results: vectors of another length, null ones and those with a null or non-finite
component are left out; of equal hashes of vec_id the lesser vector comes first as a centroid;
fewer vectors than centroids give as many centroids; null and repeated ids keep a row per row;
an empty table gives no rows; extra columns are ignored.  A component beyond MOST (after
scaling) is an error, as squared distances would not fit a long.
"""

from __future__ import annotations

import uuid
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import materialise, shared_dir

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: bits of a cell; the greatest component; vectors bounded at a time; vectors of a bucket, about.
BITS, MOST, BLOCK, BUCKET_ROWS = 6, 1 << 27, 4_096, 400_000


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """row (a number of its own), vec_id and v (an array of integers) of the vectors that are kept."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    big = lambda e: F.abs(e) > MOST
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("double"))
    rows = vectors.where((F.size(x) == dimensions) & finite).select(F.col(id_col).alias("vec_id"), v.alias("v"))
    whole = F.when(F.exists("v", big), F.raise_error(F.lit(f"a component beyond {MOST}"))).otherwise(F.col("v").cast("array<int>"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", whole.alias("v"))


def _matrix(column) -> np.ndarray:
    """The rows of a list column as a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def cell_edges(rows: DataFrame, dimensions: int = DIMENSIONS, bits: int = BITS) -> tuple[int, np.ndarray]:
    """The number of rows, and the bounds of the cells by dimension: cell c of dimension j holds edges[j, c] to edges[j, c + 1] - 1."""

    def run(batches):
        n, told = 0, None
        for b in batches:
            m = _matrix(b.column("v"))
            if len(m):
                here = np.stack([m.min(0), m.max(0)]).astype(float), np.stack([m.sum(0), (m.astype(float) ** 2).sum(0)])
                told = here if told is None else (np.stack([np.minimum(told[0][0], here[0][0]), np.maximum(told[0][1], here[0][1])]), told[1] + here[1])
                n += len(m)
        if n:
            flat = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (*told[0], *told[1])]
            yield pa.RecordBatch.from_arrays([pa.array([n]), *flat], names=["n", "least", "most", "sum", "square"])

    parts = rows.select("v").mapInArrow(run, "n long, least array<double>, most array<double>, sum array<double>, square array<double>")
    at = parts.select("n", F.posexplode(F.arrays_zip("least", "most", "sum", "square")).alias("j", "x"))
    told = at.groupBy("j").agg(F.sum("n").alias("n"), F.min("x.least").alias("least"), F.max("x.most").alias("most"), F.sum("x.sum").alias("sum"), F.sum("x.square").alias("square")).orderBy("j").collect()
    share = [NormalDist().inv_cdf(c / (1 << bits)) for c in range(1, 1 << bits)]
    out = np.zeros((dimensions, (1 << bits) + 1), np.int64)
    for r in told:  # a row a dimension
        mean = r["sum"] / r["n"]
        spread = max(r["square"] / r["n"] - mean * mean, 0.0) ** 0.5
        inner = np.clip(np.floor([mean + spread * z for z in share]), r["least"], r["most"] + 1)
        out[r["j"]] = [int(r["least"]), *inner.astype(np.int64), int(r["most"]) + 1]
    return told[0]["n"] if told else 0, out


def approximate(m: np.ndarray, edges: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Cells of the rows of m, `bits` bits each, packed into bytes."""
    cells = np.empty(m.shape, np.uint8)
    for j in range(m.shape[1]):
        cells[:, j] = np.searchsorted(edges[j, 1:-1], m[:, j], side="right")
    single = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - bits :]
    return np.packbits(single.reshape(len(m), -1), axis=1)


def unpack(packed: np.ndarray, dimensions: int, bits: int = BITS) -> np.ndarray:
    single = np.unpackbits(packed, axis=1)[:, : dimensions * bits].reshape(len(packed), dimensions, bits)
    return (single << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)


class Bounds:
    """Lookup tables by dimension and cell: the least and greatest squared distance that a cell adds for each centroid, and the least
    that it adds to the difference of two centroids' distances."""

    def __init__(self, edges: np.ndarray, centroids: np.ndarray, bits: int = BITS):
        low, high = edges[:, :-1, None], np.maximum(edges[:, 1:, None] - 1, edges[:, :-1, None])
        at = centroids.T[:, None, :]
        below, above = low - at, at - high
        self.least = np.maximum(np.maximum(below, above), 0) ** 2
        self.most = np.maximum(np.abs(below), np.abs(above)) ** 2
        self.pairs = [(i, k) for i in range(len(centroids)) for k in range(len(centroids)) if i != k]
        one, other = (at[:, :, [p[j] for p in self.pairs]] for j in (0, 1))
        slope = -2 * (one - other)  # the difference is linear in the component, so it is least at an end of the cell
        self.apart = one * one - other * other + np.minimum(slope * low, slope * high)
        self.centroids, self.bits = centroids, bits

    def candidates(self, packed: np.ndarray) -> np.ndarray:
        """Which centroids can be the nearest, by row; of equally near ones the smaller number is."""
        cells = unpack(packed, self.centroids.shape[1], self.bits)
        near, far = np.zeros((2, len(cells), len(self.centroids)), np.int64)
        for j in range(cells.shape[1]):
            near += self.least[j, cells[:, j]]
            far += self.most[j, cells[:, j]]
        out = near <= far.min(1)[:, None]
        at = np.flatnonzero(out.sum(1) > 1)
        apart = np.zeros((len(at), len(self.pairs)), np.int64)
        for j in range(cells.shape[1]):
            apart += self.apart[j, cells[at, j]]
        for x, (i, k) in zip(apart.T, self.pairs):
            out[at, i] &= (x < 0) | ((x == 0) & (i < k))
        return out

    def nearest(self, m: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of full vectors among their candidates; ties go to the smaller number."""
        d = np.full(open_.shape, np.iinfo(np.int64).max)
        for k, c in enumerate(self.centroids):
            at = np.flatnonzero(open_[:, k])
            d[at, k] = ((m[at] - c) ** 2).sum(1)
        best = d.argmin(1)
        return best, d[np.arange(len(d)), best]


def _packed(column) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint8).reshape(len(column), -1)


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids hash least, in the order of their hashes."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    told = rows.select(h.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r["v"] for r in told], np.int64).reshape(len(told), -1 if told else 0)


class Clustering:
    """The vectors of a table, written with their approximations, and what a round of clustering does with them."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, bits: int = BITS):
        self.spark, self.dimensions, self.bits = vectors.sparkSession, dimensions, bits
        self.id_type = vectors.schema[id_col].dataType.simpleString()
        rows = quantise(vectors, id_col, vector_col, dimensions)
        self.size, self.edges = cell_edges(rows, dimensions, bits)
        self.centroids = first_centroids(rows, clusters)
        #: rows scanned and full vectors fetched by each round, the first and the last pass apart.
        self.fetched: list[tuple[int, int]] = []
        if self.size:
            self._write(rows)

    def _write(self, rows: DataFrame) -> None:
        edges, bits = self.edges, self.bits

        def run(batches):
            for b in batches:
                cells = approximate(_matrix(b.column("v")), edges, bits) if b.num_rows else np.zeros((0, 1), np.uint8)
                yield pa.RecordBatch.from_arrays([*b.columns, _binary(cells)], names=["row", "vec_id", "v", "cells"])

        # one file a bucket: dealt out as the buckets are, so that fetching need not shuffle the vectors again
        self.buckets = max(self.size // BUCKET_ROWS + 1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.name = f"vafile_{uuid.uuid4().hex}"
        whole = rows.mapInArrow(run, f"row long, vec_id {self.id_type}, v array<int>, cells binary").repartition(self.buckets, "row")
        whole.write.format("parquet").bucketBy(self.buckets, "row").option("path", f"{shared_dir(self.spark)}/{self.name}").saveAsTable(self.name)
        self.vectors = self.spark.table(self.name)

    def close(self) -> None:
        """Forget the table's name (its files stay, as results may still be read from them)."""
        if self.size:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _full_pass(self, with_sums: bool) -> DataFrame:
        """Every vector's row, vec_id, cells, cluster and distance, by bounds first; with v where the sums need it."""
        bounds = Bounds(self.edges, self.centroids, self.bits)

        def run(batches):
            for b in batches:
                for k in range(0, b.num_rows, BLOCK):
                    x = b.slice(k, BLOCK)
                    best, d = bounds.nearest(_matrix(x.column("v")), bounds.candidates(_packed(x.column("cells"))))
                    told = [x.column("row"), x.column("vec_id"), x.column("cells"), pa.array(best, pa.int32()), pa.array(d)]
                    yield pa.RecordBatch.from_arrays([*told, *([x.column("v")] if with_sums else [])], names=["row", "vec_id", "cells", "cluster", "distance", *(["v"] if with_sums else [])])

        schema = f"row long, vec_id {self.id_type}, cells binary, cluster int, distance long" + (", v array<int>" if with_sums else "")
        return self.vectors.select("row", "vec_id", "v", "cells").mapInArrow(run, schema)

    def _sums(self, moved: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(members, component sums) by cluster of rows (v, cluster, before): added to the one, taken from the other."""
        k, dims = len(self.centroids), self.dimensions

        def run(batches):
            n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                m = _matrix(b.column("v"))
                for name, sign in (("cluster", 1), ("before", -1)):
                    c = b.column(name).to_numpy(zero_copy_only=False)
                    for i in range(k):
                        mine = m[c == i]
                        n[i] += sign * len(mine)
                        total[i] += sign * mine.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(n), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

        parts = moved.select("v", "cluster", "before").mapInArrow(run, "cluster int, n long, sums array<long>")
        at = parts.select("cluster", "n", F.posexplode("sums").alias("j", "s"))
        told = at.groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        n, sums = np.zeros(k, object), np.zeros((k, dims), object)
        for r in told:  # clusters x dimensions rows
            n[r["cluster"]], sums[r["cluster"], r["j"]] = int(r["n"]), int(r["s"])
        return n, sums

    def _moved_to(self, n: np.ndarray, sums: np.ndarray) -> None:
        """Non-empty centroids become the exact floor of their members' mean."""
        self.centroids = np.array([[int(s) // int(n[i]) for s in sums[i]] if n[i] else list(self.centroids[i]) for i in range(len(n))], np.int64)

    def _scan(self, members: DataFrame) -> DataFrame:
        """row, cells, before, cluster (-1 where intervals overlap) from the approximations alone."""
        bounds = Bounds(self.edges, self.centroids, self.bits)

        def run(batches):
            for b in batches:
                for k in range(0, b.num_rows, BLOCK):
                    x = b.slice(k, BLOCK)
                    open_ = bounds.candidates(_packed(x.column("cells")))
                    best = np.where(open_.sum(1) == 1, open_.argmax(1), -1)
                    yield pa.RecordBatch.from_arrays([x.column("row"), x.column("cells"), x.column("cluster"), pa.array(best, pa.int32())], names=["row", "cells", "before", "cluster"])

        return members.select("row", "cells", "cluster").mapInArrow(run, "row long, cells binary, before int, cluster int")

    def _fetch(self, asked: DataFrame) -> DataFrame:
        """row, before, cluster, v of the rows asked for, their full vectors fetched and decided."""
        bounds = Bounds(self.edges, self.centroids, self.bits)

        def run(batches):
            for b in batches:
                for k in range(0, b.num_rows, BLOCK):
                    x = b.slice(k, BLOCK)
                    best, _ = bounds.nearest(_matrix(x.column("v")), bounds.candidates(_packed(x.column("cells"))))
                    yield pa.RecordBatch.from_arrays([x.column("row"), x.column("cells"), x.column("before"), pa.array(best, pa.int32()), x.column("v")], names=["row", "cells", "before", "cluster", "v"])

        met = asked.select("row", "before").join(self.vectors.select("row", "v", "cells"), "row")
        return met.select("row", "cells", "before", "v").mapInArrow(run, "row long, cells binary, before int, cluster int, v array<int>")

    def run(self, rounds: int = ROUNDS) -> DataFrame:
        """vec_id, cluster, distance after the rounds and the last assignment."""
        if not self.size:
            return self.spark.createDataFrame([], f"vec_id {self.id_type}, cluster int, distance long")
        members, n, sums = None, 0, 0
        for k in range(rounds):
            if k == 0:
                told = materialise(self._full_pass(True), "vafile-first")
                moved, members = told.withColumn("before", F.lit(-1)), told.select("row", "cells", "cluster")
            else:
                scanned = materialise(self._scan(members), "vafile-scan")
                # those whose intervals overlap, and those whose cluster is another now
                asked = (F.col("cluster") < 0) | (F.col("cluster") != F.col("before"))
                found = materialise(self._fetch(scanned.where(asked)), "vafile-fetched")
                self.fetched.append((self.size, found.count()))
                moved = found.where("cluster != before")
                members = scanned.where(~asked).select("row", "cells", "cluster").unionByName(found.select("row", "cells", "cluster"))
            dn, ds = self._sums(moved)
            if k and not any(dn) and not ds.any() and moved.isEmpty():
                break  # nothing moves any more
            n, sums = n + dn, sums + ds
            self._moved_to(n, sums)
        return self._full_pass(False).select("vec_id", "cluster", "distance")


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, bits: int = BITS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array) of every vector that is kept."""
    told = Clustering(vectors, id_col, vector_col, dimensions, clusters, bits)
    try:
        placed = materialise(told.run(rounds), "vafile-placed")
    finally:
        told.close()
    inertia = dict(placed.groupBy("cluster").agg(F.sum("distance")).collect())  # a row a cluster
    facts = [(k, inertia.get(k, 0), sum(inertia.values()), [int(x) for x in c]) for k, c in enumerate(told.centroids)]
    side = placed.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return placed.join(F.broadcast(side), "cluster")  # at most `clusters` rows
