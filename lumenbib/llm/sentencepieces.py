"""SentencePiece encoding and decoding of whole texts (method: vectorised merge rounds, see ``piece_codec``).

Null texts count as empty; an empty text is the end id alone and decodes to nothing. Repeated rows stay, columns
other than the named ones are not looked at, an empty table gives an empty table. The model file is read where the
tasks run, so ``path`` must name it on every executor; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenbib.llm.common import spread_small
from lumenbib.llm.piece_codec import codec
from lumenbib.llm.words import slices


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with a column of ids, the end id last."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path)
        for batch in batches:
            texts = batch.fillna("").tolist()
            yield pd.Series([r for a, b in slices(texts) for r in own.encode(texts[a:b])], dtype=object)

    return docs.withColumn(into, run(F.col(text)))


def decode(tokens: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """Text of a column of ids; a null list decodes to null."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path)
        for batch in batches:
            yield pd.Series([None if x is None else own.decode(x) for x in batch], dtype=object)

    return tokens.withColumn(into, run(F.col(ids)))


def token_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the text they decode to."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for batch in batches:
            texts = batch.fillna("").tolist()
            rows = [
                (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(whole).hexdigest())
                for a, b in slices(texts)
                for n, ids, whole in own.digests(texts[a:b])
            ]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    rows = spread_small(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")))
    return rows.select("doc_id", run("text").alias("d")).select("doc_id", "d.*")
