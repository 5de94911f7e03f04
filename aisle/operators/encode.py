"""Text to unit vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.feature import CountVectorizerModel, IDFModel, IDF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.functions import fixed_values as fv

#: A task forgets the words it has hashed when there are more of them than this.
KNOWN_WORDS = 200_000
_WORD = re.compile("[a-z0-9]+")


def text_buckets(text: Column, dim: int = fv.EMBEDDING_DIM) -> Column:
    """Hash bucket of every alphanumeric token, as text.

    md5 because other engines have it too; a bucket is its first 32 bits
    modulo the dimension.
    """
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    words = F.filter(words, lambda w: w != "")
    return F.transform(
        words,
        lambda w: (
            F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint") % dim
        ).cast("string"),
    )


@lru_cache(maxsize=16)
def _counter(application: str, dim: int) -> CountVectorizerModel:
    """Counts of the ``dim`` bucket names; one transformer per session."""
    return CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(dim)], inputCol="_buckets", outputCol="_tf"
    )


def bucket_counts(df: DataFrame, text: str, dim: int = fv.EMBEDDING_DIM) -> DataFrame:
    """``df`` plus ``_tf``: a sparse vector of token counts per bucket."""
    return _counter(df.sparkSession.sparkContext.applicationId, dim).transform(df.withColumn("_buckets", text_buckets(F.col(text), dim))).drop("_buckets")


def fit_idf(df: DataFrame, text: str, dim: int = fv.EMBEDDING_DIM) -> IDFModel:
    """Inverse document frequency per bucket: ``dim`` numbers whatever the corpus size."""
    return IDF(inputCol="_tf", outputCol="_weighted").fit(bucket_counts(df, text, dim))


def _unit_vectors(texts: Iterator[pd.Series], dim: int, normalize: bool) -> Iterator[pd.Series]:
    """Token counts per bucket, of lower-cased texts; a word met before is not hashed again."""
    known: dict[str, int] = {}
    for batch in texts:
        if len(known) > KNOWN_WORDS:
            known.clear()
        rows = []
        for text in batch:
            words = _WORD.findall(text)
            for word in set(words).difference(known):
                known[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim
            counts = np.bincount([known[w] for w in words], minlength=dim).astype(np.float64)
            if normalize and words:
                counts /= np.sqrt((counts ** 2).sum())
            rows.append(counts.astype(np.float32))
        yield pd.Series(rows, index=batch.index, dtype=object)


def encode(
    df: DataFrame, text: str, output: str = "embedding", dim: int = fv.EMBEDDING_DIM,
    idf: IDFModel | None = None, normalize: bool = True,
) -> DataFrame:
    """Add a hashed bag-of-words vector of ``text``: a projection, no shuffle.

    Empty text gives the zero vector. Without ``idf`` the buckets are those of
    :func:`text_buckets`, counted in Arrow batches.
    """
    if idf is None:
        @F.pandas_udf("array<float>")
        def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            return _unit_vectors(texts, dim, normalize)

        return df.withColumn(output, embed(F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))))
    counted, weights = idf.transform(bucket_counts(df, text, dim)), "_weighted"
    if normalize:
        counted = Normalizer(p=2.0, inputCol=weights, outputCol="_unit").transform(counted)
        weights = "_unit"
    return counted.withColumn(output, vector_to_array(F.col(weights), "float32")).drop(
        "_tf", "_weighted", "_unit"
    )


def encode_with(
    df: DataFrame, text: str, load: Callable[[], Callable[[Sequence[str]], np.ndarray]],
    output: str = "embedding", batch_size: int = fv.ENCODE_BATCH, normalize: bool = True,
    distinct: bool = True,
) -> DataFrame:
    """Add vectors from a user's model.

    ``load`` runs once per Python worker and returns ``texts -> matrix``; the
    model sees ``batch_size`` texts per call. With ``distinct`` each different
    text is encoded once and joined back on its digest.
    """
    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            rows: list[np.ndarray] = []
            for start in range(0, len(batch), batch_size):
                texts = batch.iloc[start:start + batch_size].fillna("").tolist()
                matrix = np.asarray(model(texts), dtype=np.float32)
                if normalize:
                    size = np.linalg.norm(matrix, axis=1, keepdims=True)
                    matrix = matrix / np.where(size == 0, 1, size)
                rows.extend(matrix)
            yield pd.Series(rows, index=batch.index, dtype=object)

    if not distinct:
        return df.withColumn(output, embed(F.col(text)))
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    keyed = df.withColumn("_digest", digest)
    vectors = (
        keyed.groupBy("_digest").agg(F.first(text).alias("_text"))
        .select("_digest", embed(F.col("_text")).alias(output))
    )
    return keyed.join(vectors, "_digest").drop("_digest")
