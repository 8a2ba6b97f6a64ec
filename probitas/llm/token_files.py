"""Token ids as flat unsigned integer files with 64-bit document offsets.

A folder holds, for each partition p of the documents in ascending doc_id order:
  part-p.bin  the ids of its documents one after another, little-endian, 16 bits if the
              vocabulary allows, else 32
  part-p.idx  64-bit unsigned: where each of its documents starts among all ids, and last where
              the next part starts
  part-p.ids  64-bit signed: the documents' ids
All are read by memory map. Two jobs write them: the first encodes and writes ids, and returns
one row (partition, documents, ids) each; prefix sums over these rows give every partition's
base, with which the second writes the offsets. A part is written under another name and
renamed, so that a task which runs again leaves one whole file.

The folder is in storage that all executors share; its address may name any file system that
pyarrow can open. Reading maps the file where it is local; elsewhere it reads a document's range.

Encoding: a tokenizer of the kind `BY_WORD` drops white space before it looks for tokens, so words
between spaces are encoded once and remembered; what a word gives is what the library gives for it
within its text. Any other tokenizer gets whole texts.

Defined results: a null, empty or blank text has the end id alone (a blank one what the tokenizer
gives for it, if it keeps white space); equal ids are ordered by their text; a null doc_id comes
first and is read back as the least long; an empty table has no parts; texts of any length are
encoded whole; repeated rows are written each; other columns, whatever their names, change nothing.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probitas.cluster import new_folder, ship_package, stage
from probitas.llm.common import table

_KEEP = 1 << 20
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
NULL_ID = -(1 << 63)
#: How a tokenizer says that it lower-cases, and drops white space around words, digits and signs.
BY_WORD = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
)


def by_word(tokenizer: str) -> bool:
    """Whether a tokenizer file (JSON) is of the kind that drops white space first."""
    with open(tokenizer, encoding="utf-8") as f:
        j = json.load(f)
    first = ((j.get("pre_tokenizer") or {}).get("pretokenizers") or [None])[0]
    plain = all(not a.get("lstrip") and not a.get("rstrip") and not a.get("normalized") for a in j.get("added_tokens", []))
    return (j.get("normalizer"), first) == BY_WORD and plain


class _Encoder:
    """The library's ids of texts as bytes, by words where that is right."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of, self.kind, self.known, self.by_word = Tokenizer.from_file(path), kind, {}, by_word(path)

    def _encode(self, parts: list[str]) -> None:
        for part, e in zip(parts, self.of.encode_batch(parts, add_special_tokens=False), strict=True):
            self.known[part] = np.array(e.ids, dtype=self.kind).tobytes()

    def texts(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.of.encode_batch(texts, add_special_tokens=False)]
        split = [t.split(" ") if "\n" not in t and "\t" not in t else t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        if len(self.known) > _KEEP:
            self.known = {}
        new = set().union(*split).difference(self.known)
        # trailing signs are tokens of their own after a letter: encode both apart, each once
        cut = {}
        for w in new:
            core = w.rstrip(_SIGNS)
            if core and len(core) < len(w) and core[-1].lower().isalpha() and "<|" not in w:
                cut[w] = (core, w[len(core) :])
        need = {p for pair in cut.values() for p in pair} | (new - cut.keys())
        self._encode([p for p in need if p not in self.known])
        for w, (a, b) in cut.items():
            self.known[w] = self.known[a] + self.known[b]
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


@lru_cache(maxsize=2)
def _encoder(path: str, kind: str) -> _Encoder:
    return _Encoder(path, kind)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _write(uri: str, name: str, chunks: Iterator[bytes]) -> None:
    fs, folder = _open(uri)
    task = TaskContext.get()
    apart = f"{folder}/.{name}.{task.taskAttemptId()}"
    with fs.open_output_stream(apart) as out:
        for c in chunks:
            out.write(c)
    fs.move(apart, f"{folder}/{name}")


class _File:
    """An array in a file: mapped where the file is local, read by ranges where it isn't."""

    def __init__(self, uri: str, name: str, kind: str):
        fs, folder = _open(uri)
        path, self.kind = f"{folder}/{name}", np.dtype(kind)
        local = isinstance(fs, pafs.LocalFileSystem)
        self.at = None if local else fs.open_input_file(path)
        self.size = (os.path.getsize(path) if local else self.at.size()) // self.kind.itemsize
        self.map = np.memmap(path, dtype=kind, mode="r") if local and self.size else np.empty(0, dtype=kind)

    def __getitem__(self, part: slice) -> np.ndarray:
        lo, hi, _ = part.indices(self.size)
        if self.at is None:
            return self.map[lo:hi]
        width = self.kind.itemsize
        return np.frombuffer(self.at.read_at(max(0, hi - lo) * width, lo * width), dtype=self.kind)


def with_token_counts(turns: DataFrame, tokenizer: str, marks: int = 0, out: str = "n_tokens") -> DataFrame:
    """turns with the tokens of their texts under a tokenizer file, and `marks` more."""
    ship_package(turns.sparkSession)

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        return pd.Series([len(x) // 4 + marks for x in _encoder(tokenizer, "<u4").texts([t or "" for t in s])], dtype="int64")

    return turns.withColumn(out, count("text"))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> int:
    """Write docs (doc_id, text) to folder; returns the number of parts."""
    spark = docs.sparkSession
    ship_package(spark)
    from tokenizers import Tokenizer

    kind = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    end = np.array([end_id], dtype=kind).tobytes()
    width = np.dtype(kind).itemsize

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        e, lengths, ids = _encoder(tokenizer, kind), [], []

        def chunks() -> Iterator[bytes]:
            for b in batches:
                for k in range(0, b.num_rows, 500):
                    some = b.slice(k, 500)
                    done = [x + end for x in e.texts([t or "" for t in some.column("text").to_pylist()])]
                    lengths.extend(len(x) // width for x in done)
                    ids.append(some.column("doc_id").fill_null(NULL_ID).to_numpy())
                    yield from done

        _write(folder, f"part-{p:06d}.bin", chunks())
        if lengths:
            _write(folder, f"part-{p:06d}.ids", iter([np.concatenate(ids).astype("<i8").tobytes()]))
            _write(folder, f"part-{p:06d}.len", iter([np.array(lengths, dtype="<u8").tobytes()]))
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([len(lengths)]), pa.array([sum(lengths)])], names=["p", "docs", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    made = stage(rows.mapInArrow(encode, "p int, docs long, n long"), "token-parts").orderBy("p").collect()  # one row a partition
    base = np.concatenate([[0], np.cumsum([r.n for r in made])]).astype(np.int64).tolist()
    first = {r.p: b for r, b in zip(made, base, strict=False)}
    parts = [r.p for r in made]

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                p = parts[i]
                n = _File(folder, f"part-{p:06d}.len", "<u8")[:]
                starts = np.concatenate([[0], np.cumsum(n)]).astype("<u8") + np.uint64(first[p])
                _write(folder, f"part-{p:06d}.idx", iter([starts.tobytes()]))
            yield b

    if parts:
        spark.range(0, len(parts), 1, len(parts)).mapInArrow(offsets, "id long").agg(F.count("*")).collect()
    with fs.open_output_stream(f"{path}/meta.json") as out:
        out.write(json.dumps({"dtype": kind, "end_id": end_id, "parts": parts, "tokens": base[-1]}).encode())
    return len(parts)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), a row for each document, from the files."""
    fs, path = _open(folder)
    with fs.open_input_stream(f"{path}/meta.json") as f:
        meta = json.loads(f.read())
    parts, kind = meta["parts"], meta["dtype"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not parts:
        return spark.createDataFrame([], schema)
    ship_package(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                p = parts[i]
                data = _File(folder, f"part-{p:06d}.bin", kind)
                idx, ids = (_File(folder, f"part-{p:06d}.{x}", k)[:] for x, k in (("idx", "<u8"), ("ids", "<i8")))
                at = (idx - idx[0]).astype(np.int64).tolist()
                crc = [zlib.crc32(data[s:e].astype("<u4").tobytes()) for s, e in zip(at, at[1:], strict=False)]
                starts = np.asarray(idx).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(ids)), pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(read, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), folder, default_tokenizer(), 2)
    return read_token_files(spark, folder)
