"""Nearest vectors by inner product, from randomly rotated one-bit codes with error bounds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import reach, sized, stored, table

#: One-bit codes of a vector: the first of its direction, each other one of what those before leave.
LEVELS = 8
#: Components of the vectors whose codes meet in one tile, queries of a tile, estimates worked out at a time.
ELEMENTS, QUERIES, ESTIMATES = 1 << 22, 4096, 1 << 22
#: Standard deviations of a code's error that its bound allows for, and the share of a length that arithmetic may add.
BOUND, ROUNDING = 3.0, 1e-5
SEED = 20_240_527


@lru_cache(64)
def rotation(dim: int, level: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every node."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, level]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def lengths(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of each vector and its direction, without under- or overflow of squares."""
    largest = np.abs(vectors).max(axis=1)
    scaled = vectors / largest[:, None]
    short = np.linalg.norm(scaled, axis=1)
    return largest * short, scaled / short[:, None]


def encode(directions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated direction and of what each level leaves of it, how far along each code (a corner of the
    cube, at length 1) it goes, and the length of what is left at the end."""
    left, dim = directions, directions.shape[1]
    bits, along = [], []
    for level in range(LEVELS):
        turned = left @ rotation(dim, level)
        sign = np.where(turned > 0, 1.0, -1.0) / np.sqrt(dim)
        along.append((turned * sign).sum(axis=1))
        bits.append(np.packbits(turned > 0, axis=1))
        left = left - along[-1][:, None] * (sign @ rotation(dim, level).T)
    return np.concatenate(bits, axis=1), np.stack(along, axis=1), np.linalg.norm(left, axis=1)


def estimates(directions: np.ndarray, codes: np.ndarray, along: np.ndarray) -> np.ndarray:
    """Estimated inner products of query directions with coded directions (queries x vectors), from bits and scalars alone.
    What the codes of a vector say is added up over its levels once, for all queries."""
    dim, width = directions.shape[1], codes.shape[1] // LEVELS
    said = np.zeros((len(codes), dim), dtype=np.float32)
    for level in range(LEVELS):
        sign = np.unpackbits(codes[:, level * width : (level + 1) * width], axis=1, count=dim).astype(np.float32) * 2 - 1
        said += (sign * (along[:, level, None] / np.sqrt(dim)).astype(np.float32)) @ rotation(dim, level).T.astype(np.float32)
    return directions.astype(np.float32) @ said.T


def _codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for dim, same in pdf.groupby(pdf.embedding.map(len)):
            length, directions = lengths(np.stack(same.embedding.to_numpy()).astype(np.float64))
            bits, along, left = encode(directions)
            yield pd.DataFrame({"row": same.row, "dim": dim, "code": [c.tobytes() for c in bits], "along": list(along), "left": left, "length": length})


def _tile(k: int):
    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """Of the tile's vectors, for each of its queries, those whose estimate plus bound reaches the k-th best estimate less
        bound. Estimates and bounds are for a query of length 1."""
        out: dict[str, list[np.ndarray]] = {"query_row": [], "row": [], "low": [], "high": []}
        if len(vectors) and len(queries):
            vectors = vectors.sort_values("row", ignore_index=True)
            rows, length = vectors.row.to_numpy(), vectors.length.to_numpy()
            codes = np.frombuffer(b"".join(vectors.code), dtype=np.uint8).reshape(len(vectors), -1)
            along = np.stack(vectors.along.to_numpy())
            _, asked = lengths(np.stack(queries.embedding.to_numpy()).astype(np.float64))
            bound = length * (BOUND * vectors.left.to_numpy() / np.sqrt(max(1, asked.shape[1] - 1)) + ROUNDING)
            step = max(1, ESTIMATES // len(vectors))
            for at in range(0, len(queries), step):
                near = estimates(asked[at : at + step], codes, along)
                for n, row in enumerate(near, at):
                    guess = row * length
                    low, high, own = guess - bound, guess + bound, queries.row.iloc[n]
                    other = np.flatnonzero(rows != own)
                    if len(other) > k:
                        least = np.partition(low[other], len(other) - k)[len(other) - k]
                        other = other[high[other] >= least]
                    for name, value in zip(out, (np.full(len(other), own), rows[other], low[other], high[other]), strict=True):
                        out[name].append(value)
        return pd.DataFrame({name: np.concatenate(v) if v else np.zeros(0) for name, v in out.items()}).astype({"query_row": "int64", "row": "int64"})

    return search


def _products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        scores = [float(np.dot(np.asarray(a, dtype=np.float64), np.asarray(b, dtype=np.float64))) for a, b in zip(pdf.asked, pdf.embedding, strict=True)]
        yield pd.DataFrame({"query_row": pdf.query_row, "query_id": pdf.query_id, "vec_id": pdf.vec_id, "score": scores})


def candidates(numbered: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_row, row of the pairs that bounds leave for exact scores, of numbered(row, embedding) and asked(row, embedding)."""
    coded = stored(numbered.select("row", "embedding").mapInPandas(_codes, "row long, dim int, code binary, along array<double>, left double, length double"), "codes")
    total, widest, wanted = coded.count(), coded.agg(F.max("dim")).first()[0], asked.count()
    blocks = -(-total * widest // ELEMENTS)
    parts = max(-(-wanted // QUERIES), min(wanted, -(-numbered.sparkSession.sparkContext.defaultParallelism // blocks)))
    own = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = coded.withColumn("block", own(blocks)).withColumn("part", every_one(parts))
    right = asked.select("row", "embedding", F.size("embedding").alias("dim")).withColumn("part", own(parts)).withColumn("block", every_one(blocks))
    keys = ("dim", "block", "part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_tile(k), "query_row long, row long, low double, high double")
    found = stored(found, "near")
    best = Window.partitionBy("query_row").orderBy(F.col("low").desc())
    least = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("least"))
    least = least.select("query_row", F.when(F.col("n") == k, F.col("least")).alias("least"))
    return found.join(sized(stored(least, "least")), "query_row").where("least is null or high >= least").select("query_row", "row")


def without_surplus(numbered: DataFrame, k: int) -> DataFrame:
    """numbered(row, vec_id, embedding) without copies that can't be among k nearest: of equal vectors, which tie for every
    query, those with the k + 1 smallest vec_ids are enough, one of them perhaps being the query."""
    copies = (F.xxhash64("embedding").alias("a"), F.xxhash64("embedding", F.lit(1)).alias("b"))
    hashed = numbered.select("*", *copies)
    many = stored(hashed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select("a", "b"), "copied")
    if many.isEmpty():
        return numbered
    first = Window.partitionBy("a", "b").orderBy("vec_id", "row")
    some = hashed.select("row", "vec_id", "a", "b").join(sized(many), ["a", "b"]).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    others = hashed.join(sized(many), ["a", "b"], "left_anti").select(numbered.columns)
    return others.unionByName(numbered.join(sized(stored(some.select("row"), "copies")), "row", "left_semi").select(numbered.columns))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """For each row of vectors(vec_id, embedding) whose vec_id is divisible by `every`: query_id, rank (from 1), vec_id,
    score of the k other rows with the largest inner product in double precision; ties go to the smaller vec_id. Fewer
    candidates give fewer rows.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null vec_id, take no part;
    vectors meet others of their own dimension only. A repeated row is a query and a candidate as often as it comes; other
    columns don't count. An empty table gives no rows.

    Every row is coded once, but for copies beyond the k + 1 with the smallest vec_ids, which no query needs. Codes and queries meet in tiles of bounded size, dealt by row number, so no value of a key can
    make a task large; only codes are copied for tiles. Bounds choose the pairs, a few more than k a query, that are scored on
    the original vectors."""
    reach(vectors.sparkSession)
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null").where(whole)
    numbered = stored(usable.withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = numbered.where(F.pmod("vec_id", F.lit(every)) == 0)
    if asked.isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pairs = stored(candidates(without_surplus(numbered, k), asked, k), "pairs")
    queries = asked.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    scored = pairs.join(numbered, "row").join(queries, "query_row").select("query_row", "query_id", "vec_id", "embedding", "asked")
    scored = scored.mapInPandas(_products, "query_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nearest of the table embeddings: each vec_id divisible by 20 against all rows. What it does with odd rows is said
    there."""
    return nearest(table(spark, sf_dir, "embeddings"))
