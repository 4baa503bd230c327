"""Vectors: cosine similarity, stub embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.names import let

STUB_SIZE = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 for other lengths, zero vectors and nulls."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm), F.lit(0.0))


def stub_doubles(text: Column) -> Column:
    """A unit vector of 64 numbers from the bytes of the text's SHA-256, twice over; each is a whole number through one root."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)

    def scaled(byte: Column) -> Column:
        return let(F.sqrt(F.aggregate(byte, F.lit(0.0), lambda s, x: s + x * x)), lambda norm: F.transform(byte, lambda x: F.when(norm > 0, x / norm).otherwise(0.0)))

    made = let(digest, lambda t: F.transform(F.sequence(F.lit(0), F.lit(STUB_SIZE - 1)), lambda i: F.conv(F.substring(t, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")))
    return let(made, scaled)


def stub_vector(text: Column) -> Column:
    """stub_doubles as the floats that an index stores."""
    return stub_doubles(text).cast("array<float>")


def three_decimals(x: Column) -> Column:
    """printf's %.3f of a double from 0 to 1. format_number rounds the double itself, but for 0.0005, as C does; format_string rounds its shortest decimal, half up."""
    return F.when(x.between(0.0005, 0.001), "0.001").otherwise(F.format_number(x, 3))
