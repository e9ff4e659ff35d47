"""Text embedding. An embedder is a function from a text column to an array<float> column.

The default hashes words into signed buckets. Words are split and hashed in the JVM; the
Arrow UDF only adds up one batch of hash codes with numpy. A caller with a real model wraps it in
``model_embedder``, or passes a pandas or Arrow iterator UDF.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetrove.session import ship_to_active

Embedder = Callable[[Column], Column]

WORD_BREAK = r"[^\p{L}\p{N}]+"


def word_codes(text: Column) -> Column:
    """First five hex digits of each word's md5, as integers: four for the bucket, one for the sign."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 5), 16, 10).cast("int"))


def bucket_sums(codes: pa.Array, dims: int) -> np.ndarray:
    """One unit-length row per list of codes; a row without words stays zero."""
    lengths = codes.value_lengths().to_numpy(zero_copy_only=False)
    values = codes.flatten().to_numpy(zero_copy_only=False)
    cells = np.repeat(np.arange(len(codes)), lengths) * dims + (values // 16) % dims
    signs = np.where(values % 16 < 8, 1.0, -1.0)
    rows = np.bincount(cells, weights=signs, minlength=len(codes) * dims)
    rows = rows.astype(np.float64).reshape(len(codes), dims)
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def hashed_embedder(dims: int = 384) -> Embedder:
    ship_to_active()

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(codes: pa.Array) -> pa.Array:
        rows = bucket_sums(codes, dims).astype(np.float32)
        offsets = np.arange(0, (len(codes) + 1) * dims, dims, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))

    return lambda text: embed(word_codes(text))


def model_embedder(make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 30) -> Embedder:
    """An embedder around any model that turns an array of texts into a matrix.

    ``make_model`` runs once in each Python worker, so a model is loaded there and not sent from the
    driver; the function it returns gets at most ``batch_size`` texts at a time. Null texts are empty.
    """
    from pyspark.ml.functions import predict_batch_udf

    ship_to_active()
    predict = predict_batch_udf(make_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return lambda text: predict(F.coalesce(text, F.lit("")))


def word_model(dims: int = 384) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """The hashed embedder's vectors, made as a model: texts in, a matrix out."""
    def make() -> Callable[[np.ndarray], np.ndarray]:
        word = re.compile(r"[^\W_]+")

        def predict(texts: np.ndarray) -> np.ndarray:
            codes = [[int(hashlib.md5(w.encode()).hexdigest()[:5], 16) for w in word.findall(t.lower())] for t in texts]
            return bucket_sums(pa.array(codes, pa.list_(pa.int32())), dims).astype(np.float32)

        return predict

    return make
