"""Text to vector through a user model, one load per Python worker and batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwell.functions.text import one_line

# A model: called once per worker, gives a function (texts, task) -> one list of floats per text
ModelFactory = Callable[[], Callable[[list[str], str], list]]

DIM = 64
VECTOR = pa.list_(pa.float32())
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # spreads trigrams over the dimensions


def hashed_grams(dim: int = DIM) -> ModelFactory:
    """A model-free default: hashed character trigrams, normalised to length 1. Same text, same vector."""
    def load():
        def embed(texts: list[str], task: str) -> list:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for i, text in enumerate(texts):
                data = np.frombuffer(f"  {text.lower()} ".encode(), dtype=np.uint8).astype(np.uint64)
                grams = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
                places = (grams * MULTIPLIER >> np.uint64(20)) % np.uint64(dim)
                out[i] = np.bincount(places.astype(np.int64), minlength=dim)
            lengths = np.linalg.norm(out, axis=1, keepdims=True)
            return list(out / np.where(lengths > 0, lengths, 1))

        return embed

    return load


def _vectors(run: Callable[[list[str], str], list], texts: list[str | None], task: str) -> pa.Array:
    """A vector for each text that is there."""
    result = [None] * len(texts)
    present = [i for i, t in enumerate(texts) if t is not None]
    if present:
        for i, v in zip(present, run([texts[i] for i in present], task)):
            result[i] = [float(x) for x in v]
    return pa.array(result, VECTOR, from_pandas=True)


def embed(
    df: DataFrame, text_col: str, model: ModelFactory | None = None, *, task: str = "document", batch: int = 256,
    out: str = "embedding",
) -> DataFrame:
    """``df`` with the vector of ``text_col``. ``task`` tells the model stored texts from questions; a null
    text has no vector."""
    factory = model or hashed_grams()

    @F.arrow_udf("array<float>")
    def vectors(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = factory()
        for column in texts:
            # of a batch only so many texts are Python's at a time, and no vector is for long
            parts = [_vectors(run, column.slice(start, batch).to_pylist(), task) for start in range(0, len(column), batch)]
            yield pa.concat_arrays(parts) if parts else pa.array([], VECTOR)

    return df.withColumn(out, vectors(one_line(F.col(text_col))))


def projection_2d(rows: DataFrame) -> DataFrame:
    """Vectors (id, role, embedding) as points in the plane: first two principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    features = rows.withColumn("_v", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(features)
    point = vector_to_array("_p")
    return model.transform(features).select("id", "role", point[0].alias("x"), point[1].alias("y"))
