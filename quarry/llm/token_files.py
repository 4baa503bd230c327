"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes."""

from __future__ import annotations

import os
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm import _bytes
from quarry.llm._spark import materialize, parallelism, shared_dir

#: Distinct words whose ids a Python worker remembers in each of two generations; longer words aren't remembered.
CACHED_WORDS, CACHED_BYTES = 550_000, 48
#: Documents, and bytes of them, whose words are looked up together; a longer text is alone.
_GROUP, _GROUP_BYTES = 2500, 32 << 20
#: The same for documents whose ids are written together.
_BLOCK, _BLOCK_BYTES = 2048, 8 << 20
_MAGIC = b"QTOK1\0\0\0"
_HEAD = "<QQQQ"

_tokenizers: dict[str, object] = {}


@dataclass(frozen=True)
class TokenFiles:
    """manifest: Parquet table (part, path, n_docs, n_tokens); ranks: the id of each rank."""

    manifest: str
    ranks: tuple[int, ...]


class _Coder:
    """Ids of texts as packed bytes. Where the tokenizer drops white space and never joins across it, a text's
    ids are those of its words in order, and each distinct word is encoded once; other tokenizers see whole texts."""

    _PROBES = ("a b", "The end.\tof it", "x\n\ny, z", "\u00e9t\u00e9 \u00fcber", "it's 12 34")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.by_words = all(self._ids(t) == [i for w in t.split() for i in self._ids(w)] for t in self._PROBES)
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode_each(self, texts: list[str], dtype: str) -> list[bytes]:
        return [np.array(e.ids, dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_letters(self, cores: list[str], dtype: str) -> list[bytes]:
        """Words of letters, encoded as one text: each ends with the only token that closes a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(cores)], add_special_tokens=False)[0].ids, dtype)  # without offsets
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(cores):
            return self._encode_each(cores, dtype)
        cuts = (ends * ids.itemsize).tolist()
        packed = ids.tobytes()
        return [packed[i:j] for i, j in zip([0, *cuts[:-1]], cuts, strict=True)]

    def learn(self, new: list[bytes], dtype: str) -> dict[bytes, bytes]:
        """Ids of words: Latin letters with a full stop or comma at most by their letters, all others as they are."""
        ascii_ = [w for w in new if w.isalpha()]
        out = dict(zip(ascii_, self._encode_letters(b" ".join(ascii_).decode().split(" "), dtype), strict=True)) if ascii_ else {}
        mixed = [w for w in new if not w.isalpha()]
        texts = b"\n".join(mixed).decode().split("\n") if mixed else []
        cut = [(t[:-1], t[-1]) if t[-1] in ".," else (t, "") for t in texts]
        latin = not mixed or max(map(max, texts)) <= "\u00ff"
        plain = [c.isalpha() and (latin or max(c) <= "\u00ff") for c, _ in cut]
        cores = list({c for (c, _), ok in zip(cut, plain, strict=True) if ok})
        ids = dict(zip(cores, self._encode_letters(cores, dtype), strict=True)) if cores else {}
        other = [t for t, ok in zip(texts, plain, strict=True) if not ok]
        ids_other = iter(self._encode_each(other, dtype) if other else ())
        tails = {"": b""} | {t: np.array(self._ids(t), dtype).tobytes() for t in ".,"}
        out.update((w, ids[core] + tails[tail] if ok else next(ids_other)) for w, (core, tail), ok in zip(mixed, cut, plain, strict=True))
        return out

    def encode(self, texts: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, end to end, and where each text's ids end; null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_words:
            bodies = self._encode_each(texts.to_pylist(), dtype)
            joined = np.frombuffer(b"".join(bodies), dtype)
            return joined, np.cumsum([len(b) // joined.itemsize for b in bodies], dtype=np.int64)
        lists = pc.ascii_split_whitespace(texts)  # at exactly the six white-space bytes of the word class
        words, last = lists.values, lists.offsets.to_numpy()[1:]
        solid = pc.binary_length(words).to_numpy() > 0  # leading and trailing space leave empty words
        if not solid.all():
            last = np.concatenate([[0], np.cumsum(solid)])[last]
            words = words.filter(pa.array(solid))
        coded = words.dictionary_encode()
        ids = self._ids_of(coded.dictionary.cast(pa.large_binary()).to_pylist(), dtype)
        pool = np.frombuffer(b"".join(ids), dtype)
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // pool.itemsize
        at = coded.indices.to_numpy()
        count = length[at]
        ends = np.concatenate([[0], np.cumsum(count)])
        source = np.repeat((np.cumsum(length) - length)[at] - ends[:-1], count) + np.arange(ends[-1])
        return pool[source], ends[last]

    def _ids_of(self, words: list[bytes], dtype: str) -> list[bytes]:
        """Ids of distinct words, from the memory where it has them."""
        if len(self.known) > CACHED_WORDS:  # words not met for a whole generation go
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, words))
        missing = [i for i, v in enumerate(found) if v is None]
        if missing:
            new = [words[i] for i in missing]
            have = {w: v for w, v in zip(new, map(self.older.get, new), strict=True) if v is not None}
            if rest := [w for w in new if w not in have]:
                have |= self.learn(rest, dtype)
            for i, w in zip(missing, new, strict=True):
                found[i] = have[w]
            self.known.update(have)
            if max(map(len, new)) > CACHED_BYTES:
                for w in new:
                    if len(w) > CACHED_BYTES:
                        del self.known[w]
        return found


def _groups(sizes: np.ndarray, rows: int, size: int):
    """Runs (lo, hi) of at most so many rows and bytes, at least one row each."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield lo, hi
        lo = hi


def _sizes_of(column: pa.Array) -> np.ndarray:
    return pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)


def _load(path: str) -> _Coder:
    if path not in _tokenizers:
        _tokenizers[path] = _Coder(path)
    return _tokenizers[path]


def _tokenize(path: str, end_id: int, dtype: str):
    end = np.array([end_id], dtype).tobytes()

    def run(batches):
        coder = _load(path)
        pack = zstandard.ZstdCompressor(level=1)
        size = max(coder.size, end_id + 1)
        total = np.zeros(size, np.int64)
        names = ["id", "body", "counts"]
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in _groups(_sizes_of(texts), _GROUP, _GROUP_BYTES):
                ids, ends = coder.encode(texts.slice(lo, hi - lo), dtype)
                total += np.bincount(ids, minlength=size)
                total[end_id] += len(ends)
                packed, cuts = ids.tobytes(), (ends * ids.itemsize).tolist()
                bodies = [pack.compress(packed[i:j] + end) for i, j in zip([0, *cuts[:-1]], cuts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(bodies, pa.binary()), pa.nulls(len(bodies), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names)

    return run


def _count(batches):
    """token, n of the counts that every partition of the tokenizing pass left."""
    for batch in batches:
        for body in batch.column("counts").to_pylist():
            total = np.frombuffer(body, np.int64)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["token", "n"])


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _write(folder: str, rank_of: np.ndarray, dtype: str):
    """One file a partition. Its name is new for each attempt; only those of finished tasks are listed."""

    def run(batches):
        system, place = _open(folder)
        part = TaskContext.get().partitionId()
        name = f"{place}/part-{part:06d}-{uuid.uuid4().hex}.tok"
        unpack = zstandard.ZstdDecompressor()
        out, docs, tokens = None, 0, 0
        for batch in batches:
            for lo, hi in _groups(_sizes_of(batch.column("body")), _BLOCK, _BLOCK_BYTES):
                ids = batch.column("id").slice(lo, hi - lo)
                bodies = [np.frombuffer(unpack.decompress(b), dtype) for b in batch.column("body").slice(lo, hi - lo).to_pylist()]
                if out is None:
                    out = system.open_output_stream(name)
                    out.write(_MAGIC)
                lengths = np.array([len(b) for b in bodies], "<i8")
                control, data = _bytes.encode(rank_of[np.concatenate(bodies)])
                present = np.array([i is not None for i in ids.to_pylist()], np.uint8)
                out.write(struct.pack(_HEAD, len(bodies), int(lengths.sum()), len(control), len(data)))
                for piece in (ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), present.tobytes(), lengths.tobytes(), control, data):
                    out.write(piece)
                docs, tokens = docs + len(bodies), tokens + int(lengths.sum())
        if out is not None:
            out.close()
            scheme = folder.split("://")[0] + "://" if "://" in folder else ""
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([scheme + name]), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64())], ["part", "path", "n_docs", "n_tokens"])

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text: str = "text", folder: str | None = None) -> TokenFiles:
    """Encodes every whole text, appends end_id, and writes files whose documents follow ascending ids.

    Null and blank texts have the end id alone; very long texts are encoded whole, apart from others; repeated rows
    are all written; other columns are ignored, whatever their names. Null ids come first; rows of one id are ordered by
    their ids' bytes. An empty table writes no files. Frequencies are counted over all documents, and
    rank 0 is the most frequent id; the ranks (at most the vocabulary's size) pass through the driver.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    size = max(_load(tokenizer).size, end_id + 1)
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    made = materialize(source.mapInArrow(_tokenize(tokenizer, end_id, dtype), "id long, body binary, counts binary"), "ids")
    counted = made.select("counts").filter("counts is not null").mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    coded = made.select("id", "body").filter("body is not null")
    ranks = [r["token"] for r in sorted(counted.collect(), key=lambda r: (-r["n"], r["token"]))]  # at most the vocabulary
    rank_of = np.zeros(size, np.uint32)
    rank_of[np.array(ranks, np.int64)] = np.arange(len(ranks), dtype=np.uint32)
    if folder.startswith("file:") or folder.startswith("/"):
        _open(folder)[0].create_dir(_open(folder)[1], recursive=True)
    ordered = coded.repartitionByRange(parallelism(docs), "id").sortWithinPartitions("id", "body")
    manifest = f"{folder}/manifest"
    ordered.mapInArrow(_write(folder, rank_of, dtype), "part int, path string, n_docs long, n_tokens long").write.parquet(manifest)
    return TokenFiles(manifest, tuple(ranks))


def _read(id_of: np.ndarray):
    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                system, place = _open(path)
                with system.open_input_stream(place) as f:
                    if f.read(len(_MAGIC)) != _MAGIC:
                        raise ValueError(f"not a token file: {path}")
                    while head := f.read(struct.calcsize(_HEAD)):
                        docs, tokens, n_control, n_data = struct.unpack(_HEAD, head)
                        ids = np.frombuffer(f.read(8 * docs), "<i8")
                        present = np.frombuffer(f.read(docs), np.uint8).astype(bool)
                        lengths = np.frombuffer(f.read(8 * docs), "<i8")
                        control = np.frombuffer(f.read(n_control), np.uint8)
                        values = id_of[_bytes.decode(control, f.read(n_data), tokens)]
                        ends = np.cumsum(lengths)
                        offsets = pa.py_buffer((4 * np.concatenate([[0], ends])).astype("<i8"))
                        bodies = pa.Array.from_buffers(pa.large_binary(), docs, [None, offsets, pa.py_buffer(values.astype("<u4"))]).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~present), pa.array(start + ends - lengths), pa.array(lengths), bodies], ["id", "start", "n_tokens", "ids"])
                        start += int(ends[-1])

    return run


def read_token_files(spark: SparkSession, files: TokenFiles, id_col: str = "doc_id") -> DataFrame:
    """id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit) from the files."""
    manifest = spark.read.schema("part int, path string, n_docs long, n_tokens long").parquet(files.manifest)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each file
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("path", "start")
    id_of = np.array(files.ranks, np.uint32)
    rows = placed.repartition(parallelism(manifest)).mapInArrow(_read(id_of), "id long, start long, n_tokens long, ids binary")
    return rows.withColumnRenamed("id", id_col)
