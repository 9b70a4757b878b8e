"""Column expressions over dense and hashed vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bigrams, words

EPSILON = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(vector) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(EPSILON))


def normalized(a: Column) -> Column:
    return F.transform(doubles(a), lambda x: x / F.greatest(norm(a), F.lit(EPSILON)))


def sign_agreement(a: Column, b: Column, dim: int) -> Column:
    """Similarity of vectors kept as one bit a dimension."""
    return dot(F.transform(doubles(a), F.signum), F.transform(doubles(b), F.signum)) / dim


def quantized(a: Column, low: Column, high: Column) -> Column:
    """Each dimension on 256 steps between its limits, half to even."""
    step = F.zip_with(low, high, lambda lo, hi: F.when(hi - lo < 1e-9, 1.0).otherwise((hi - lo) / 255.0))
    cells = F.arrays_zip(doubles(a).alias("x"), low.alias("low"), step.alias("step"))
    return F.transform(cells, lambda s: F.rint((s["x"] - s["low"]) / s["step"]) * s["step"] + s["low"])


def hashed(texts: DataFrame, key: str, text: str, dim: int = 512) -> DataFrame:
    """key, bucket, value: the sparse signed hashing of words and bigrams, dampened."""
    ws = words(F.col(text))
    h = F.crc32(F.col("token").cast("binary"))
    each = texts.select(key, F.explode(F.concat(ws, bigrams(ws))).alias("token")).select(key, (h % dim).cast("int").alias("bucket"), F.when(F.shiftright(h, 31).bitwiseAND(1) == 1, 1).otherwise(-1).alias("sign"))
    summed = each.groupBy(key, "bucket").agg(F.sum("sign").cast("double").alias("value"))
    return summed.select(key, "bucket", (F.signum("value") * F.log1p(F.abs("value"))).alias("value"))


def dense(sparse: DataFrame, key: str, dim: int = 512) -> DataFrame:
    """key, embedding: unit vectors from hashed()."""
    cells = F.map_from_entries(F.collect_list(F.struct("bucket", "value")))
    full = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("cells")[i], F.lit(0.0)))
    rows = sparse.groupBy(key).agg(cells.alias("cells")).select(key, full.alias("raw"))
    return rows.select(key, normalized(F.col("raw")).cast("array<float>").alias("embedding"))
