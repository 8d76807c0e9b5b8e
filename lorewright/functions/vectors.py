"""Vector and score functions as Spark expressions, and batched products where a matrix is faster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lorewright.schemas import Settings


def dot(a: Column, b: Column) -> Column:
    """In double precision, in the order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """MV1; null where a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def neighbour_boost(base: Column, weight: Column) -> Column:
    """min(1, base + 0.05 log(1 + weight)); a missing or zero weight counts as 1 (MV2)."""
    w = F.coalesce(F.nullif(weight, F.lit(0.0)), F.lit(1.0))
    return F.least(F.lit(1.0), base + F.log1p(F.greatest(F.lit(0.0), w)) * 0.05)


def max_sim(query: Column, document: Column) -> Column:
    """Mean over the query's token vectors of the largest product with a document's (MV6)."""
    best = F.transform(query, lambda q: F.array_max(F.transform(document, lambda d: dot(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(query)


def weighted(semantic: Column, entity: Column, graph: Column, settings: Settings | None = None) -> Column:
    """MV4; the diversity part is the constant 1."""
    w = (settings or Settings()).weights
    return F.lit(w["semantic"]) * semantic + F.lit(w["entity"]) * entity + F.lit(w["graph"]) * graph + F.lit(w["diversity"] * 1.0)


def band(confidence: Column) -> Column:
    """MV5."""
    return F.when(confidence >= 0.75, "high").when(confidence >= 0.45, "medium").otherwise("low")


def image_rerank(cosine_: Column, colour_distance: Column, is_base: Column) -> Column:
    """0.8 cosine - 0.2 colour distance, and 0.2 more for a base image (MV19)."""
    return F.lit(0.8) * cosine_ - F.lit(0.2) * colour_distance + F.when(is_base, 0.2).otherwise(0.0)


def bhattacharyya(a: Column, b: Column) -> Column:
    """Distance of two histograms of equal length (MV9)."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x.cast("double") * y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), 1 - shared / F.nullif(F.sqrt(total(a) * total(b)), F.lit(0.0))))


def mean_squared_error(a: Column, b: Column) -> Column:
    """MV10."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def aspect_ok(width: Column, height: Column, low: float = 0.7, high: float = 1.4) -> Column:
    """FLT17."""
    return (height > 0) & (width / height).between(low, high)


def token_select(tokens: Column, share: float = 0.5) -> Column:
    """The share of token vectors that are most like their mean, best first (MV8)."""
    size = F.size(F.get(tokens, 0))
    mean = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.aggregate(tokens, F.lit(0.0), lambda s, t: s + F.get(t, k).cast("double")) / F.size(tokens))
    ranked = F.array_sort(F.transform(tokens, lambda t, i: F.struct((-cosine(t, mean)).alias("s"), i.alias("i"))))
    kept = F.slice(ranked, F.lit(1), F.greatest(F.lit(1), F.floor(F.size(tokens) * F.lit(share)).cast("int")))
    return F.transform(kept, lambda x: F.get(tokens, x["i"]))


def padding_select(patches: Column, share: float = 0.05) -> Column:
    """Indexes of patches with at least the share of elements that aren't black (MV7)."""
    lit = lambda p: F.size(F.filter(p, lambda v: v > 0)) >= F.size(p) * F.lit(share)
    return F.transform(F.filter(F.transform(patches, lambda p, i: F.struct(i.alias("i"), lit(p).alias("ok"))), lambda x: x["ok"]), lambda x: x["i"])


#: Images that a worker gives at a time: 16 of 224 x 224 are 6 MB.
IMAGES = 16


@F.pandas_udf(ArrayType(DoubleType()))
def letterbox(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A grey image (row by row) padded to a square with black and resized to 224 by nearest pixel (MV11)."""
    for pixels, width, height in batches:
        for at in range(0, len(pixels), IMAGES):
            part = slice(at, at + IMAGES)
            yield pd.Series([_letterboxed(p, w, h) for p, w, h in zip(pixels[part], width[part], height[part], strict=True)])


def _letterboxed(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    side = max(width, height)
    square = np.zeros((side, side))
    square[(side - height) // 2 : (side - height) // 2 + height, (side - width) // 2 : (side - width) // 2 + width] = np.asarray(pixels, float).reshape(height, width)
    at = np.arange(224) * side // 224
    return square[at][:, at].ravel()
