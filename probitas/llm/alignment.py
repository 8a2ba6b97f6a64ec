"""Alignment of two tokenizers' tokens over one text.

Both tokenizers encode each text; their tokens' bytes must both spell a space and the text. Then
tokens are byte ranges that cover the same bytes. Each batch of documents is one pair of pandas
frames, keyed by document and sorted by byte: `merge_asof` gives for the start of each token the
other side's token that covers it. Two ranges overlap exactly where one of them starts inside the
other, so the union of both directions holds every overlap. Where both sides end a token at one
byte, a group ends.

Links of ids are counted over the whole corpus in two steps. Counts of id pairs are one
aggregation with map-side combine. To bring a count back to each link, the pairs with the highest
counts, at most `HOT` of them as counted beforehand, are broadcast; what they don't hold, which has
no frequent key left, is joined by a shuffle. So no frequent pair meets in one task, and no
broadcast grows with the data.

Files of tokenizers are read where tasks run: their paths must exist on the executors.

Defined results: a text that is null or empty, or whose bytes either side doesn't spell (it has
what a tokenizer changes or drops), has no tokens; repeated rows are aligned and counted each; null
ids are kept; texts of any length are aligned whole; an empty table gives an empty result; other
columns, whatever their names, change nothing.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from probitas.cluster import scratch, ship_package, stage
from probitas.llm.common import table

#: Pairs of ids whose counts are broadcast, at most.
HOT = 1 << 18
#: Chunks of text that a Python process remembers, about, and as many older ones.
KEEP = 100_000
#: Bytes of text that one pair of frames holds, about.
PORTION = 1 << 18


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for
    themselves, the others in order for 256 and on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


LETTERS, SPACES = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", " \\n"
#: Signs beyond those of which all libraries hold one view.
UNSURE = re.compile(f"[^\\x21-\\x7e{SPACES}{LETTERS}\u2013\u2014\u2018\u2019\u201c-\u201e\u2026\u20ac]")
#: Parts of a text at whose ends no token reaches over; letters behind an apostrophe stay with it.
CHUNKS = re.compile(f" ?[{LETTERS}]+| ?[^{SPACES}{LETTERS}]+(?:(?<=')[{LETTERS}]+)?|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


class _ByteLevel:
    """Tokenizer file (JSON) with a byte-level vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        vocab, byte = self.library.get_vocab(), _byte_of()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        by = said.get("pre_tokenizer") or {}
        # the byte-level pattern parts texts before the merges, wherever CHUNKS does
        self.by_chunk = not said.get("normalizer") and by.get("type") == "ByteLevel" and not by.get("add_prefix_space") and by.get("use_regex", True)

    def encode(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)]


class _Pieces:
    """Model file with pieces that write a space as U+2581 and single bytes as <0xHH>; it puts a space
    before the text. If no piece holds a letter beside another sign, a space behind a character, or a line
    end, no merge reaches over the ends of CHUNKS."""

    MIXED = re.compile(f"[{LETTERS}][^{LETTERS}]|[^{LETTERS}\u2581][{LETTERS}]|[^\u2581]\u2581|\\n")

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n, special = self.library.get_piece_size(), (self.library.is_byte, self.library.is_control, self.library.is_unknown)
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        plain = (p for i, p in enumerate(pieces) if not any(f(i) for f in special))
        self.by_chunk = not any(self.MIXED.search(p) for p in plain if not UNSURE.search(p.replace("\u2581", " ")))
        self.before = {lead: len(self.library.encode(lead)) for lead in "a("}

    def encode(self, chunks: list[str]) -> list[list[int]]:
        # the library's space is wanted before a chunk that begins with one; before others a sign takes it
        lead = ["" if c[0] == " " else "(" if c[0].isalpha() else "a" for c in chunks]
        made = self.library.encode([x + c if x else c[1:] for x, c in zip(lead, chunks, strict=True)], num_threads=1)
        return [ids[self.before[x] :] if x else ids for x, ids in zip(lead, made, strict=True)]


class _Pair:
    """Both sides' ids of texts after a space, as bytes, and None for a text that either side's tokens don't
    spell. What the libraries give for a chunk is remembered while it is used, where both part texts at chunks."""

    def __init__(self, a_path: str, b_path: str):
        self.sides = [_Pieces(p) if p.endswith(".model") else _ByteLevel(p) for p in (a_path, b_path)]
        self.sizes = [np.fromiter(map(len, x.bytes), dtype=np.int64, count=len(x.bytes)) for x in self.sides]
        self.by_chunk = all(x.by_chunk for x in self.sides)
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.older: dict[str, tuple[bytes, bytes] | None] = {}

    def split(self, text: str) -> list[str] | None:
        """The chunks of a space and the text, or None where only the whole will do."""
        plain = self.by_chunk and "  " not in text and text[0] != " " != text[-1] and not UNSURE.search(text)
        return CHUNKS.findall(" " + text) if plain else None

    def whole(self, chunks: list[str]) -> list[tuple[bytes, bytes] | None]:
        said, made = [c.encode("utf-8", "surrogatepass") for c in chunks], [s.encode(chunks) for s in self.sides]
        good = np.ones(len(chunks), dtype=bool)
        for side, sizes, ids in zip(self.sides, self.sizes, made, strict=True):
            good &= self._spelled(said, ids, side.bytes, sizes)
        return [(array("i", x).tobytes(), array("i", y).tobytes()) if ok else None for ok, x, y in zip(good.tolist(), *made, strict=True)]

    @staticmethod
    def _spelled(said: list[bytes], ids: list[list[int]], bytes_: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Which chunks their tokens spell. If each has as many bytes as its tokens and all in a row are equal, all are."""
        flat = list(chain.from_iterable(ids))
        n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        ends = np.concatenate([[0], np.cumsum(sizes[np.array(flat, dtype=np.int64)])])
        long = np.diff(ends[np.concatenate([[0], np.cumsum(n)])])
        if np.array_equal(long, np.fromiter(map(len, said), dtype=np.int64, count=len(said))) and b"".join(map(bytes_.__getitem__, flat)) == b"".join(said):
            return np.ones(len(said), dtype=bool)
        return np.array([b"".join(map(bytes_.__getitem__, x)) == c for x, c in zip(ids, said, strict=True)], dtype=bool)

    def of(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        split = [self.split(t) for t in texts]
        if len(self.known) > KEEP:
            self.known, self.older = {}, self.known
        known, new = self.known, []
        for c in set().union(*filter(None, split)).difference(known):
            if c in self.older:
                known[c] = self.older[c]
            else:
                new.append(c)
        known.update(zip(new, self.whole(new), strict=True))
        out: list[tuple[bytes, bytes] | None] = []
        for chunks in split:
            parts = [None] if chunks is None else [*map(known.__getitem__, chunks)]
            out.append(None if None in parts else tuple(map(b"".join, zip(*parts, strict=True))))
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.whole([" " + texts[i] for i in rest]), strict=True):
            out[i] = x
        return out


@lru_cache(maxsize=2)
def _pair(a_path: str, b_path: str) -> _Pair:
    return _Pair(a_path, b_path)


def _side(ids: list[bytes], sizes: np.ndarray) -> pd.DataFrame:
    """A row for each token: its document, id, place in the document, and byte range among all documents."""
    n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
    flat = np.frombuffer(b"".join(ids), dtype=np.int32).astype(np.int64)
    size = sizes[flat]
    end = np.cumsum(size)  # documents follow each other, so byte ranges of all of them increase
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    return pd.DataFrame({"doc": np.repeat(np.arange(len(ids)), n), "id": flat, "place": place, "start": end - size, "end": end})


def links_of(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """(doc, a, b): the places of each two tokens that overlap, by document."""
    # both sides cover the same bytes of each document, and byte ranges follow each other, so the token that covers
    # a start is of the same document; only its row is merged
    at = [x[["start"]].assign(row=np.arange(len(x))) for x in (a, b)]
    cover = pd.merge_asof(at[0][["start"]], at[1], on="start")["row"].to_numpy().astype(np.int64)
    back = pd.merge_asof(at[1][["start"]], at[0], on="start")["row"].to_numpy().astype(np.int64)
    start, doc, place_a, place_b = a["start"].to_numpy(), a["doc"].to_numpy(), a["place"].to_numpy(), b["place"].to_numpy()
    own = np.flatnonzero(start[back] != b["start"].to_numpy())  # tokens that start together are in cover already
    of = np.concatenate([doc, doc[back[own]]])
    by = np.argsort(of, kind="stable")
    return pd.DataFrame({"doc": of[by], "a": np.concatenate([place_a, place_a[back[own]]])[by], "b": np.concatenate([place_b[cover], place_b[own]])[by]})


@lru_cache(maxsize=4)
def _numbers(n: int, last: str) -> np.ndarray:
    """The texts of the numbers below n before a comma, then before `last`."""
    return np.array([f"{i}," for i in range(n)] + [f"{i}{last}" for i in range(n)], dtype=object)


def group_texts(a: pd.DataFrame, b: pd.DataFrame, last_a: np.ndarray, last_b: np.ndarray, docs: int) -> Iterator[str]:
    """The groups of each document as text: `a1,a2|b1;a3|b2,b3`. last_a and last_b are the rows that end groups."""
    parts = np.empty(len(a) + len(b), dtype=object)
    lasts = (last_a, last_b)
    for x, k, sign in ((a, 0, "|"), (b, 1, ";")):
        ends = np.zeros(len(x), dtype=bool)
        ends[lasts[k]] = True
        table = _numbers(1 << int(x["id"].max()).bit_length() if len(x) else 0, sign)
        # side a of a group comes after the other side's groups before it, side b after its own group's too
        before = np.concatenate([[0], lasts[1 - k] + 1])[np.cumsum(ends) - ends + k]
        parts[np.arange(len(x)) + before] = table[x["id"].to_numpy() + ends * (len(table) // 2)]
    parts = parts.tolist()
    sizes = np.bincount(a["doc"], minlength=docs) + np.bincount(b["doc"], minlength=docs)
    at = 0
    for n in sizes.tolist():
        yield "".join(parts[at : at + n])[:-1]
        at += n


#: What align() can give.
OUTPUTS = {
    "a_ids": "array<int>", "b_ids": "array<int>", "group_a": "array<int>", "group_b": "array<int>", "link_a": "array<int>", "link_b": "array<int>",
    "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string",
}
ARRAYS = tuple(OUTPUTS)[:6]


def align_batch(texts: list[str | None], a_path: str, b_path: str, outputs: tuple[str, ...] = ARRAYS) -> list[pa.Array]:
    """The outputs for some texts."""
    pair, full = _pair(a_path, b_path), [i for i, t in enumerate(texts) if t]
    spelled = [(i, x) for i, x in zip(full, pair.of([texts[i] for i in full]), strict=True) if x is not None]
    good = [i for i, _ in spelled]
    a, b = (_side([x[k] for _, x in spelled], pair.sizes[k]) for k in (0, 1))
    link = links_of(a, b)
    ends = np.intersect1d(a["end"].to_numpy(), b["end"].to_numpy(), assume_unique=True)
    last = [np.searchsorted(x["end"].to_numpy(), ends) for x in (a, b)]
    docs = {"a": a["doc"].to_numpy(), "b": b["doc"].to_numpy(), "link": link["doc"].to_numpy()}
    docs["group"] = docs["a"][last[0]]
    first = {x: np.searchsorted(docs[x], docs["link"]) for x in ("a", "b")} if "link_a" in outputs or "link_b" in outputs else {}
    at = np.array(good, dtype=np.int64)

    def per_text(of: str) -> np.ndarray:
        count = np.zeros(len(texts), dtype=np.int64)
        count[at] = np.bincount(docs[of], minlength=len(good))
        return count

    def lists(values: np.ndarray, of: str) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_text(of))]), pa.int32()), pa.array(values, pa.int32()))

    def digests() -> pa.Array:
        out = [""] * len(texts)
        for i, said in zip(good, group_texts(a, b, *last, len(good)), strict=True):
            out[i] = hashlib.sha256(said.encode()).hexdigest()
        return pa.array(out, pa.string())

    make = {
        "a_ids": lambda: lists(a["id"], "a"),
        "b_ids": lambda: lists(b["id"], "b"),
        "group_a": lambda: lists(np.diff(last[0], prepend=-1), "group"),
        "group_b": lambda: lists(np.diff(last[1], prepend=-1), "group"),
        "link_a": lambda: lists(a["id"].to_numpy()[first["a"] + link["a"].to_numpy()], "link"),
        "link_b": lambda: lists(b["id"].to_numpy()[first["b"] + link["b"].to_numpy()], "link"),
        "n_a": lambda: pa.array(per_text("a")),
        "n_b": lambda: pa.array(per_text("b")),
        "n_groups": lambda: pa.array(per_text("group")),
        "n_links": lambda: pa.array(per_text("link")),
        "groups_sha256": digests,
    }
    return [make[o]() for o in outputs]


def _portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of rows that follow each other and hold about PORTION bytes, a row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy() + 64)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(size, (size[first - 1] if first else 0) + PORTION)) + 1
        yield first, min(end, len(texts)) - first
        first = end


def align(docs: DataFrame, a_path: str, b_path: str, outputs: tuple[str, ...] = ARRAYS) -> DataFrame:
    """doc_id and the outputs, a row for each row of docs (doc_id, text): the ids of both sides, how many of
    each side every group has, both ids of every overlap; or the numbers of these, and the SHA-256 of the
    groups as text ('' without tokens)."""
    ship_package(docs.sparkSession)
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(", ".join(f"{o} {OUTPUTS[o]}" for o in outputs)).fields])
    arrow = to_arrow_schema(schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(*p) for p in _portions(batch.column("text"))):
                made = [part.column("doc_id"), *align_batch(part.column("text").to_pylist(), a_path, b_path, outputs)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, arrow, strict=True)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(of, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, n, best) of links (link_a, link_b): how many links hold the pair, and whether no pair of b has more."""
    each = links.select(F.explode(F.arrays_zip("link_a", "link_b")).alias("l")).select(F.col("l.link_a").alias("a"), F.col("l.link_b").alias("b"))
    counted = stage(each.groupBy("a", "b").agg(F.count("*").alias("n")), "pairs")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def hot_cut(counts: DataFrame, limit: int) -> int:
    """The least count such that at most `limit` pairs have it or more. Counts meet in bins of an eighth of a doubling."""
    bins = counts.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("bin")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("bin")).collect()  # 512 rows at most
    cut, sum_ = bins[0].least if bins else 1, 0
    for b in bins:
        sum_ += b.pairs
        if sum_ > limit:
            return cut if b is not bins[0] else int(counts.agg(F.max("n")).first()[0]) + 1
        cut = b.least
    return cut


def link_sums(links: DataFrame, hot: int = HOT) -> DataFrame:
    """(row, n_best, count_sum) of links (row, link_a, link_b): over each row's links, how many are of the
    highest count of their b, and the sum of counts. Rows without links don't appear. links is read three times."""
    counts = stage(pair_counts(links), "counts")
    cut = hot_cut(counts, hot)
    key = (F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair")
    sums = [F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    top = F.broadcast(counts.filter(F.col("n") >= cut).select(key, "n", "best"))  # `hot` rows at most
    pair = F.shiftleft(F.col("l.link_a").cast("long"), 32) + F.col("l.link_b")
    each = links.select("row", F.explode(F.arrays_zip("link_a", "link_b")).alias("l")).select("row", pair.alias("pair"), F.lit(1).cast("long").alias("times"))
    done = each.join(top, "pair").groupBy("row").agg(*sums)
    if counts.filter(F.col("n") < cut).isEmpty():
        return done
    rare = each.join(top, "pair", "left_anti").groupBy("row", "pair").agg(F.count("*").alias("times"))
    late = rare.join(counts.filter(F.col("n") < cut).select(key, "n", "best"), "pair").groupBy("row").agg(*sums)
    return done.union(late).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align_digests(docs: DataFrame, a_path: str, b_path: str, hot: int = HOT) -> DataFrame:
    """The figures of each document's alignment, with counts of its links over all documents."""
    figures = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    made = align(docs, a_path, b_path, (*figures, "link_a", "link_b")).withColumn("row", F.monotonically_increasing_id())
    with scratch(docs.sparkSession) as keep:
        made = stage(made, "aligned")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        whole = made.drop("link_a", "link_b").join(link_sums(made.select("row", "link_a", "link_b"), hot), "row", "left")
        return keep(whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"), "alignment")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_digests(table(spark, sf_dir, "documents"), *default_paths())
