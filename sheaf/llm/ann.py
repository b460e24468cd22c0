"""Nearest neighbours by inner product, by multiprobe p-stable hashing.

Inner products become distances by one more component, ``sqrt(m^2 - |x|^2)`` for the
largest norm ``m`` and 0 for queries. Each table has ``hashes`` projections on Gaussian
(2-stable) vectors, cut into ``cells`` cells of width ``width`` with random offsets, the
outer ones open. A query visits the buckets of a table in the order of the squared
distances from its projections to their cells, the estimated order of success, until
they hold ``share`` of all vectors (and more than ``k``). Candidates of all tables are
ranked together by their inner products in double precision, ties by smaller id.

Buckets are packed into blocks of about ``block_rows`` vectors and larger ones are
split, queries go in chunks: a task compares a block with a chunk and passes on ``k``
rows per query. The directory of buckets has ``tables * cells ** hashes`` rows at most,
whatever the data.

Cases: vectors that are null, zero, of another length than most or with null or
non-finite components take no part, nor do rows without id; of rows with one id the
first by hash counts; a query does not find itself; with ``k`` candidates or fewer all
are found; without vectors or queries the result is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheaf.llm.common import kept

TABLES, HASHES, CELLS, WIDTH, SHARE = 2, 10, 2, 1.0, 0.55
BLOCK_ROWS, CHUNK_ROWS, STEP = 8192, 4096, 256
_SLACK = 1e-9


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): vectors that take part, in double precision."""
    v = F.col(vec_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    found = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))
    return found.groupBy("id").agg(F.min_by("v", F.struct(F.xxhash64("v"), F.col("v"))).alias("v"))


class Hashes:
    """The tables' projections; the same seed gives the same ones everywhere."""

    def __init__(self, dim: int, norm: float, tables: int, hashes: int, cells: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.norm, self.cells, self.hashes, self.tables = norm, cells, hashes, tables
        self.a = rng.normal(size=(dim + 1, tables * hashes)) / width
        self.b = rng.uniform(0, 1, tables * hashes)
        self.low = -(cells // 2)

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Positions in cells; queries are scaled to length 1, which keeps their order."""
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) if query else self.norm)
        more = np.zeros((len(x), 1)) if query else np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))
        return (np.hstack([x, more]) @ self.a + self.b).reshape(len(x), self.tables, self.hashes)

    def codes(self, positions: np.ndarray) -> np.ndarray:
        cell = np.clip(np.floor(positions), self.low, self.low + self.cells - 1).astype(np.int64) - self.low
        return (cell * self.cells ** np.arange(self.hashes)).sum(-1)

    def misses(self, positions: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Per query and bucket: the squared distances to the bucket's cells."""
        cell = codes[:, None] // self.cells ** np.arange(self.hashes) % self.cells + self.low
        left = np.where(cell == self.low, -np.inf, cell)
        right = np.where(cell == self.low + self.cells - 1, np.inf, cell + 1)
        far = np.maximum(0, np.maximum(left - positions[:, None], positions[:, None] - right))
        return (far**2).sum(-1)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _top(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int):
    """The best ``k`` of candidates, sums taken alike wherever a vector stands."""
    x, ids = x[ids != own], ids[ids != own]
    rough = x @ q
    if len(ids) > k:
        least = np.partition(rough, len(rough) - k)[len(rough) - k]
        near = rough >= least - _SLACK * np.abs(x).max() * np.abs(q).sum()
        x, ids = x[near], ids[near]
    exact = (x * q).sum(1)
    order = np.lexsort((ids, -exact))[:k]
    return ids[order], exact[order]


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES,
    hashes: int = HASHES, cells: int = CELLS, width: float = WIDTH, share: float = SHARE, seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest ``vectors`` found per query."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    base = kept(usable(vectors, id_col, vec_col), "vectors")
    most = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if most is None:
        return spark.createDataFrame([], schema)
    dim = most.d
    base, asked = base.where(F.size("v") == dim), usable(queries, id_col, vec_col).where(F.size("v") == dim)
    norm = base.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)))).first()[0]
    how = Hashes(dim, norm, tables, hashes, cells, width, seed)

    def coded(batches):
        for b in batches:
            codes = how.codes(how.project(_matrix(b.column(1)), query=False)) if b.num_rows else np.zeros((0, tables), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables), pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], ["id", "v", "codes"])

    dealt = kept(base.mapInArrow(coded, "id long, v array<double>, codes array<long>"), "coded")
    per = dealt.select("id", "v", F.posexplode("codes").alias("t", "code"))
    directory = [{} for _ in range(tables)]
    for r in per.groupBy("t", "code").count().collect():
        directory[r.t][r.code] = r["count"]
    total = sum(directory[0].values())

    # Blocks: runs of buckets, in order of code, of about BLOCK_ROWS; (block, slices).
    place: list[dict[int, tuple[int, int]]] = [{} for _ in range(tables)]
    for t in range(tables):
        block = held = 0
        for code, n in sorted(directory[t].items()):
            if held and held + n > BLOCK_ROWS:
                block, held = block + 1, 0
            place[t][code] = (block, -(-n // BLOCK_ROWS))
            held += n
    known = [(np.array(list(d)), np.array(list(d.values()))) for d in directory]
    n_queries = asked.count()
    chunks = max(1, -(-n_queries // CHUNK_ROWS))

    def probing(batches):
        for b in batches:
            ids, x = b.column(0).to_numpy(), _matrix(b.column(1)) if b.num_rows else np.zeros((0, dim))
            if not len(x):
                continue
            positions = how.project(x, query=True)
            out = {c: [] for c in ("t", "block", "slice", "chunk", "query_id", "v", "codes")}
            for t, (codes, counts) in enumerate(known):
                order = np.argsort(how.misses(positions[:, t], codes), axis=1, kind="stable")
                sums = np.cumsum(counts[order], axis=1)
                for i in range(len(x)):
                    n = int(np.searchsorted(sums[i], max(share * total, k + 1))) + 1
                    visits: dict[tuple[int, int], list[int]] = {}
                    for code in codes[order[i, :n]].tolist():
                        block, slices = place[t][code]
                        for s in range(slices):
                            visits.setdefault((block, s), []).append(code)
                    for (block, s), some in visits.items():
                        row = (t, block, s, int(ids[i]) % chunks, int(ids[i]), x[i], some)
                        for name, value in zip(out, row, strict=True):
                            out[name].append(value)
            types = [pa.int32()] * 4 + [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out.values(), types, strict=True)], list(out))

    key = ["t", "block", "slice", "chunk"]
    probes = asked.mapInArrow(
        probing, "t int, block int, slice int, chunk int, query_id long, v array<double>, codes array<long>"
    )

    def placing(batches):
        for b in batches:
            where = [place[t][c] for t, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            ids = b.column(0).to_pylist()
            block = pa.array([w[0] for w in where], pa.int32())
            slices = pa.array([i % w[1] for i, w in zip(ids, where, strict=True)], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, block, slices], ["id", "v", "t", "code", "block", "slice"])

    rows = per.select("id", "v", F.col("t").cast("int").alias("t"), "code").mapInArrow(
        placing, "id long, v array<double>, t int, code long, block int, slice int"
    )
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            x, ids, code = _matrix(left["v"]), left["id"].to_numpy(), left["code"].to_numpy()
            qs, q_ids, visits = _matrix(right["v"]), right["query_id"].to_numpy(), right["codes"].to_pylist()
            for i in range(len(qs)):
                inside = np.isin(code, visits[i])
                found, score = _top(x[inside], ids[inside], qs[i], q_ids[i], k)
                out["query_id"].append(np.full(len(found), q_ids[i]))
                out["vec_id"].append(found)
                out["score"].append(score)
        kinds = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pa.table({c: np.concatenate(v).astype(kinds[c]) if v else np.array([], kinds[c]) for c, v in out.items()})

    near = rows.groupBy(*key).cogroup(probes.groupBy(*key)).applyInArrow(compare, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
