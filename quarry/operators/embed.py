"""Vectors of symbols: signature, documentation, body."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.vectors import stub_vector


def embed_symbols(symbols: DataFrame, model: Callable[[Column], Column] = stub_vector, only_missing: bool = True, body_chars: int | None = None) -> DataFrame:
    """Fills embed_sig, embed_doc (of the docstring, else the signature, else the name) and embed_body.

    model maps a text column to a vector column: an expression, or a pandas UDF around a real model. Bodies are
    passed whole, or by their first ``body_chars`` characters for models that take no more.
    """
    body = F.coalesce("body", F.lit(""))
    signature = F.coalesce("signature", F.lit(""))
    doc = F.coalesce(F.when(F.col("docstring") != "", F.col("docstring")), F.when(signature != "", signature), F.col("name"))
    made = {"embed_sig": model(signature), "embed_doc": model(doc), "embed_body": model(body if body_chars is None else F.substring(body, 1, body_chars))}
    if only_missing and "embed_body" in symbols.columns:
        made = {c: F.when(F.col("embed_body").isNull(), v).otherwise(F.col(c)) for c, v in made.items()}
    return symbols.withColumns(made)
