"""Language identification by compression with per-language zstandard raw-content dictionaries."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Bounds of the labelled sample: texts of a language, and characters taken from each.
SAMPLE_TEXTS, SAMPLE_CHARS = 160, 700
#: Those of a longer text are so many pieces over its whole length.
SAMPLE_PIECES = 7
#: A prediction is rejected if the next language needs less than this share of bytes more.
MARGIN = 0.01
LEVEL = 3
#: Texts are encoded in pieces: beyond some kilobytes a text would compress against itself, not the dictionary.
PIECE = 2048
_LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> bytes:
    """The runs of letters of a whole text in lower case, which is what is encoded."""
    return " ".join(_LETTERS.findall(text.lower())).encode()


def _spread(text: Column, h: Column) -> Column:
    """SAMPLE_CHARS characters of a text in pieces at places hashed from h, one in each stretch of the whole text, none twice."""
    size = SAMPLE_CHARS // SAMPLE_PIECES
    rest = F.char_length(text) - SAMPLE_CHARS

    def piece(k: Column) -> Column:
        unit = F.pmod(F.xxhash64(h, k), F.lit(1 << 20)) / float(1 << 20)
        return F.substring(text, (k * size + F.floor(rest * ((k + unit) / SAMPLE_PIECES)) + 1).cast("int"), F.lit(size))

    return F.when(rest <= 0, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_PIECES - 1)), piece), " "))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, bytes]:
    """One raw dictionary a language, from at most SAMPLE_TEXTS texts: the least hash of each hash bucket,
    and of a text longer than SAMPLE_CHARS characters pieces from all over it.

    Aggregation finds the sample, so no language's rows meet in a task; the sample (bounded by languages
    times SAMPLE_TEXTS * SAMPLE_CHARS) is all that reaches the driver. Null languages or texts teach nothing.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key).alias("h"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    picked = rows.groupBy("lang", F.pmod("h", F.lit(SAMPLE_TEXTS)).alias("bucket")).agg(F.min("h").alias("h")).drop("bucket")
    # languages x SAMPLE_TEXTS rows are broadcast; copies of a key give one text
    sample = rows.join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "h").agg(F.min(_spread(F.col("text"), F.col("h"))).alias("t"))
    found: dict[str, list[tuple[int, bytes]]] = {}
    for r in sample.collect():
        found.setdefault(r["lang"], []).append((r["h"], letters(r["t"])))
    joined = {k: b" ".join(t for _, t in sorted(v)) for k, v in sorted(found.items())}
    return {k: v for k, v in joined.items() if v}


def _sizes(dictionaries: dict[str, bytes]):
    names = list(dictionaries)

    def coders():
        for name in names:
            own = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False, min_match=4, strategy=zstandard.STRATEGY_GREEDY, window_log=18, hash_log=17, chain_log=17, search_log=4)
            own.precompute_compress(compression_params=params)
            yield zstandard.ZstdCompressor(dict_data=own, compression_params=params)

    def run(batches):
        # greedy matching: optimal parsing weighs literals in a way that blurs short texts (95 against 99 % right)
        encode = [c.compress for c in coders()]
        for batch in batches:
            best, first, second = [], [], []
            for text in batch.column("text").to_pylist():
                body = letters(text or "")
                parts = [body[i : i + PIECE] for i in range(0, max(1, len(body)), PIECE)]
                sizes = np.array([sum(len(e(p)) - 4 for p in parts) for e in encode])
                order = np.argsort(sizes, kind="stable")
                best.append(names[order[0]])
                first.append(int(sizes[order[0]]))
                second.append(int(sizes[order[1]]) if len(names) > 1 else 2 * int(sizes[order[0]]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(best, pa.string()), pa.array(first, pa.int64()), pa.array(second, pa.int64())], [*(c for c in batch.schema.names if c != "text"), "_best", "_first", "_second"])

    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, then lang_pred, score, rejected for every row and its whole text.

    lang_pred is the language whose dictionary encodes the text smallest, ``und`` for null texts and
    those without a letter, or if nothing was learned. score falls from 1 to 0.5 as the lead over the next language
    vanishes, 0 for und. rejected marks und and leads below MARGIN, where a filter should not trust
    the prediction. Equal sizes go to the first language in order of name. Very long texts are encoded whole, piece
    by piece; repeated rows are judged alike; an empty table gives an empty one; kept columns may have any names.
    """
    # a handful of columns, none of which can clash with the caller's names
    source = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"), F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)).alias("letters"))
    names = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    if not dictionaries:
        return source.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "text")
    sized = source.mapInArrow(_sizes(dictionaries), f"{schema}, _best string, _first long, _second long")
    lead = (F.col("_second") - F.col("_first")) / F.greatest(F.col("_second"), F.lit(1))
    known = F.col("letters")
    score = 1 - 0.5 * F.exp(-lead * 20)
    return sized.select(*names, F.when(known, F.col("_best")).otherwise(UNKNOWN).alias("lang_pred"), F.when(known, score).otherwise(0.0).alias("score"), (~known | (lead < MARGIN)).alias("rejected"))


def held_out(key: Column) -> Column:
    """The fold that training never sees: crc32 of the id as text, modulo 4, is 2. A null id is in neither part."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
