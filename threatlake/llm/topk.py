"""Exact top-k inner products over norm-sorted vectors with rotated partial sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake.llm.common import range_parts, shared_path
from threatlake.llm.files import map_shared, pack_arrays, unpack_arrays, write_shared
from threatlake.session import materialise

#: Vectors of a candidate block and of a query block: what a task holds at a time.
BLOCK, QUERIES = 4096, 1024
#: Leading rotated coordinates that are multiplied for every pair that a block's longest vector allows.
HEAD = 16
#: Above this size of an inner product doubles are not exact, and Python's integers take over.
EXACT = 1 << 52


def quantised(vector: str, scale: int) -> Column:
    """``floor(scale * x)`` of every component, as doubles; null where a component is null or not finite."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(F.col(vector).isNotNull() & fine, F.transform(x, lambda v: F.floor(v * F.lit(scale)).cast("double")))


def _stack(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _moments(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            v = _stack(batch.column(0), size)
            total += v.T @ v
        yield pa.record_batch({"m": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

    return run


def _rotation(vectors: DataFrame, size: int) -> np.ndarray:
    """Right singular vectors of all vectors, the strongest first, from summed second moments (size x size)."""
    sums = vectors.select("v").mapInArrow(_moments(size), "m array<double>").select(F.posexplode("m")).groupBy("pos").agg(F.sum("col").alias("x")).collect()
    moments = np.zeros(size * size)
    for row in sums:
        moments[row.pos] = row.x
    if not moments.any() or not np.isfinite(moments).all():
        return np.eye(size)
    _, vectors_ = np.linalg.eigh(moments.reshape(size, size))
    return vectors_[:, ::-1].copy()


def _blocks(path: str, kind: str, size: int, rotation: np.ndarray, per_block: int):
    """Write the rows of a task, longest first, as files of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids, held, number, part = [], [], 0, None

        def close() -> pa.RecordBatch:
            nonlocal held_ids, held, number
            ids, v = np.concatenate(held_ids), np.concatenate(held)
            turned = v @ rotation
            rest = np.sqrt(np.maximum(0, (turned[:, HEAD:] ** 2).sum(axis=1)))
            norms = np.sqrt((v ** 2).sum(axis=1))
            uri = f"{path}/{kind}-{part:08d}-{number:06d}.vec"
            write_shared(uri, pack_arrays({"ids": ids, "v": v, "head": turned[:, :HEAD].copy(), "rest": rest, "norms": norms}))
            row = pa.record_batch({"uri": pa.array([uri]), "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "rows": pa.array([len(ids)], pa.int64()),
                                   "longest": pa.array([float(norms.max())]), "widest": pa.array([float(np.abs(v).max()) if v.size else 0.0])})
            held_ids, held, number = [], [], number + 1
            return row

        for batch in batches:
            ids, v, parts = batch.column(0).to_numpy(), _stack(batch.column(1), size), batch.column(2)
            part = parts[0].as_py() if part is None else part
            for k in range(0, len(ids), per_block):
                held_ids.append(ids[k:k + per_block])
                held.append(v[k:k + per_block])
                if sum(map(len, held_ids)) >= per_block:
                    yield close()
        if held_ids:
            yield close()

    return run


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _search(queries: list[str], k: int, exact: bool):
    """Every query block against the candidate blocks of a task, which come longest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uris = [u for b in batches for u in b.column("uri").to_pylist()]
        for query_uri in queries if uris else []:
            q = {n: np.array(x) for n, x in unpack_arrays(map_shared(query_uri)).items()}
            count = len(q["ids"])
            floor = q["floor"].copy()  # the k-th score known so far
            kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * count
            for uri in uris:
                c = unpack_arrays(map_shared(uri))
                norms, ids = c["norms"], c["ids"]
                # Bounds in doubles get a margin far above their rounding.
                margin = 1e-6 + 1e-9 * q["norms"] * norms.max()
                live = np.flatnonzero(q["norms"] * norms.max() + margin >= floor)
                if not len(live):
                    continue
                bound = q["head"][live] @ c["head"].T + np.outer(q["rest"][live], c["rest"]) + margin[live][:, None]
                for row, i in enumerate(live.tolist()):
                    near = np.flatnonzero((bound[row] >= floor[i]) & (ids != q["ids"][i]))
                    if not len(near):
                        continue
                    if exact:
                        scores = c["v"][near] @ q["v"][i]
                    else:
                        own = [int(x) for x in q["v"][i].tolist()]
                        scores = np.array([sum(int(x) * y for x, y in zip(v, own)) for v in c["v"][near].tolist()], object)
                    old_scores, old_ids = kept[i]
                    kept[i] = _best(np.concatenate([old_scores, scores]), np.concatenate([old_ids, ids[near]]), k)
                    if len(kept[i][0]) == k:
                        floor[i] = max(floor[i], float(kept[i][0][-1]) - (0 if exact else margin[i]))
            full = [i for i in range(count) if len(kept[i][0])]
            if not exact and any(abs(s) >= 1 << 63 for i in full for s in kept[i][0].tolist()):
                raise ValueError("an inner product among the highest does not fit 64 bits")
            if full:
                yield pa.record_batch({
                    "query_id": pa.array(np.repeat(q["ids"][full], [len(kept[i][0]) for i in full])), "vec_id": pa.array(np.concatenate([kept[i][1] for i in full])),
                    "score": pa.array([int(s) for i in full for s in kept[i][0].tolist()], pa.int64())})

    return run


def top_inner_products(df: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k largest integer inner products of each query: ``query_id, rank, vec_id, score``.

    Components become ``floor(scale * x)``. Rows for which ``is_query`` holds are the queries;
    candidates are all rows but those with the query's own id. Ties go to the smaller id; a
    query has fewer rows only if there are fewer candidates. Vectors that are null, or have a
    null, NaN or infinite component, take no part, nor do rows without an id; vectors of
    another length than the first (by most rows, then length) raise an error. Repeated rows
    count each. An empty table gives no rows. Scores beyond 64 bits raise an error.

    Vectors are dealt by length to ranges and written, longest first, as blocks: integers,
    leading coordinates after rotation onto the singular vectors, and the norm of the others.
    The longest block gives each query a first k-th score. Then tasks take candidate blocks
    in turn with every query block, which they map from the shared folder: a block whose
    longest vector can't reach a query's k-th score is passed over, a pair whose head plus
    the Cauchy-Schwarz bound of the rest can't is not multiplied. A task keeps k rows a query.
    """
    spark = df.sparkSession
    vectors = df.select(F.col(id_col).cast("long").alias("id"), quantised(vector_col, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query")).where("id is not null and v is not null")
    lengths = vectors.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(2).collect()
    if len(lengths) > 1:
        raise ValueError("vectors differ in length")
    shape = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not lengths or not lengths[0].n:
        return spark.createDataFrame([], shape)
    size = lengths[0].n
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    vectors = vectors.withColumn("norm", norm)
    parts = range_parts(vectors, [F.desc("norm"), F.col("id")], "norm-ranges")
    rotation = _rotation(parts, size)
    path = shared_path(spark, "vectors")

    def written(rows: DataFrame, kind: str, per_block: int) -> DataFrame:
        ordered = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "_part").sortWithinPartitions("_part", F.desc("norm"), "id").select("id", "v", "_part")
        return materialise(ordered.mapInArrow(_blocks(path, kind, size, rotation, per_block), "uri string, part int, number int, rows bigint, longest double, widest double"), f"{kind}-blocks")

    blocks = written(parts, "all", BLOCK)
    asked = written(parts.where("query"), "query", QUERIES)
    widest = blocks.agg(F.max("widest")).first()[0]
    exact = size * widest * widest < EXACT
    longest = blocks.orderBy(F.desc("longest"), "part", "number").limit(1).select("uri").first()
    query_uris = [r.uri for r in asked.select("uri").collect()]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k-th score of each query in the longest block; a new file next to the old one."""
        c = unpack_arrays(map_shared(longest.uri))
        for uri in (u for b in batches for u in b.column("uri").to_pylist()):
            q = unpack_arrays(map_shared(uri))
            floor = np.full(len(q["ids"]), -np.inf)
            scores = q["v"] @ c["v"].T
            scores[q["ids"][:, None] == c["ids"][None]] = -np.inf
            if scores.shape[1] >= k:
                floor = np.partition(scores, -k, axis=1)[:, -k]
            floor = floor - (0 if exact else 1e-6 + 1e-9 * q["norms"] * float(c["norms"].max()))
            write_shared(uri + ".start", pack_arrays({**q, "floor": floor}))
            yield pa.record_batch({"uri": pa.array([uri + ".start"])})

    started = materialise(asked.select("uri").repartition("uri").mapInArrow(start, "uri string"), "query-starts")
    query_uris = [r.uri for r in started.collect()]
    # A task takes every n-th block, so each has long and short ones.
    tasks = max(1, min(blocks.count(), 4 * spark.sparkContext.defaultParallelism))
    dealt = blocks.select("uri", "longest", "part", "number").withColumn("task", F.pmod(F.xxhash64("uri"), F.lit(tasks)))
    found = dealt.repartition(tasks, "task").sortWithinPartitions(F.desc("longest")).select("uri").mapInArrow(
        _search(query_uris, k, exact), "query_id bigint, vec_id bigint, score bigint")
    best = F.row_number().over(_order_by_query())
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _order_by_query():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
