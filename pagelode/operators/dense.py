"""Dense vectors: cosine ranking by brute force, int8 quantisation, and fusion with lexical hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.operators.lexical import fuse, ranked

BLOCK_ROWS = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def normalised(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(F.lit(0.0)))


def mean_vector(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, embedding): the mean of the vectors of each key, at length one."""
    flat = rows.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    whole = flat.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("xs"))  # as many as dimensions
    return whole.select(*keys, normalised(F.transform("xs", lambda p: p["x"])).alias("embedding"))


def _blocks(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(keys, width, units): runs of up to BLOCK_ROWS rows, their vectors at length one as one matrix. Null vectors give none."""
    kind = rows.schema[key].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(1)))
            sizes = pc.list_value_length(batch.column(1)).to_numpy()
            for width in np.unique(sizes).tolist():
                mine = batch.filter(pa.array(sizes == width))
                units = mine.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
                length = np.sqrt((units * units).sum(axis=1, keepdims=True))
                units = np.divide(units, length, out=np.zeros_like(units), where=length > 0)
                for at in range(0, len(units), BLOCK_ROWS):
                    ids = mine.column(0).slice(at, BLOCK_ROWS)
                    held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                    yield pa.RecordBatch.from_arrays([held, pa.array([width], pa.int32()), pa.array([units[at : at + BLOCK_ROWS].tobytes()], pa.binary())], names=["keys", "width", "units"])

    return rows.select(key, vector).mapInArrow(pack, f"keys array<{kind}>, width int, units binary")


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, floor: float = 0.0, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, doc, score, rank): a stated set of queries (query, vector) against all vectors, block by block.

    Each pair of blocks is one matrix product, and only its best k of each query leave the task (and what rounding may
    put beside them). Vectors of another width than the query's aren't compared.
    """
    asked = _blocks(queries, "query", "vector").toDF("queries", "width", "asked")
    kinds = queries.schema["query"].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                width = batch.column("width")[n].as_py()
                told = [np.frombuffer(batch.column(c)[n].as_buffer(), float).reshape(-1, width) for c in ("asked", "units")]
                scores = told[0] @ told[1].T
                cut = np.full(len(scores), floor)
                if scores.shape[1] > k:
                    cut = np.maximum(cut, np.partition(scores, -k, axis=1)[:, -k] - 2e-6)
                q, d = np.nonzero((scores >= cut[:, None]) & (scores > floor))
                yield pa.RecordBatch.from_arrays([batch.column("queries")[n].values.take(pa.array(q)), batch.column("keys")[n].values.take(pa.array(d)), pa.array(scores[q, d])], names=["query", "doc", "score"])

    pairs = _blocks(vectors, id_col, vector).join(asked, "width")
    hits = pairs.mapInArrow(best, f"query {kinds[0]}, doc {kinds[1]}, score double")
    return ranked(hits, (), k, ("doc",))


def quantise(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vectors with scale and q: whole numbers of -127 to 127 that times the scale give the vector."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127).otherwise(F.lit(1.0))
    return vectors.withColumn("scale", scale).withColumn("q", F.transform(vector, lambda x: F.floor(x.cast("double") / F.col("scale") + 0.5).cast("tinyint")))


def dequantised(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: x * scale)


def hybrid(lexical: DataFrame, dense: DataFrame | None, keys: tuple[str, ...] = (), k: int | None = 10) -> DataFrame:
    """Fusion of both rankings; the lexical one alone where there are no vectors."""
    return ranked(lexical, keys, k) if dense is None else ranked(fuse([lexical, dense], keys), keys, k, ("first", "doc"))
