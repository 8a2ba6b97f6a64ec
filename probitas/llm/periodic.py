"""Periodic runs of words inside one document, by seeds that are extended along their diagonal.

A run is a stretch of words with smallest period q (words q apart are equal) of at least
max(`min_words`, `min_exponent` * q) words that no neighbouring word extends. Words q apart that
are equal stand on the diagonal of lag q; a run of period q covers at least
max(min_words - q, (min_exponent - 1) * q) places of it without a gap. The least of these over
all q is the length of the grams that are indexed for lags up to that length; for longer lags the
length doubles from octave to octave, and stays below what their runs guarantee.

Seeds are pairs of neighbouring places of one gram in one document, at a lag within the gram's
octave. Neighbours are enough: a gram at least as long as the lag that came again nearer than one
period inside a run would give the run a shorter period. So each octave has at most as many seeds as
the document has words, however often a word or a line comes again. A seed is extended in both
directions unless the per-lag table of furthest covered places shows that an earlier extension
holds it already. The gram that starts a run has the run's smallest period as its least lag, so
every run is found once, with that period.

Grams are numbered, not hashed (equal numbers are equal words), by doubling: a gram's number comes
from those of its two halves, and places whose half is unique are dropped on the way, so that
ordinary text leaves the index after a few words. Runs lie inside one document, so rows need no
exchange; a very long text takes time in proportion to its words times the octaves.

Defined results: null, empty and blank texts have no words and no runs; repeated rows are marked
each; a null id is like any other; other columns stay as they are, whatever their names, and an
empty table stays empty. Runs of different periods may overlap; a word is dropped if it lies behind
the first period of any run that contains it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.cluster import ship_package
from probitas.llm.common import free, id_remainder, table, words_of

MIN_WORDS, MIN_EXPONENT = 24, 3
MARKED = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def seed_length(min_words: int, min_exponent: int) -> int:
    """The overlap that a run of any period guarantees on its diagonal."""
    return min(max(min_words - q, (min_exponent - 1) * q) for q in range(1, max(2, min_words + 1)))


def _longer(rank: np.ndarray, short: int, long: int) -> np.ndarray:
    """Numbers of the grams of `long` words from those of `short` ones (short < long <= 2 * short).
    Grams that come once, or pass the end, have -1."""
    at = np.flatnonzero(rank >= 0)
    at = at[at + (long - short) < len(rank)]
    at = at[rank[at + (long - short)] >= 0]
    out = np.full(len(rank), -1, dtype=np.int64)
    if len(at):
        _, number, times = np.unique(rank[at] * len(rank) + rank[at + (long - short)], return_inverse=True, return_counts=True)
        again = times[number] > 1
        out[at[again]] = number[again]
    return out


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values of a and b are equal; compared in pieces of growing length."""
    at, step, n = 0, 64, min(len(a), len(b))
    a, b = a[:n], b[:n]
    while at < n:
        differ = a[at : at + step] != b[at : at + step]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + len(differ), step * 2
    return n


def runs_of(words: list, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n, base = len(words), seed_length(min_words, min_exponent)
    if n < min_words:
        return []
    known: dict = {}
    word = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    if len(known) == n:
        return []
    rank, size = _longer(word * 2, 1, 2) if base > 1 else word, min(2, base)
    found, gram, least = [], base, 0
    while (rank >= 0).any():
        while size < gram:
            rank, size = _longer(rank, size, min(gram, 2 * size)), min(gram, 2 * size)
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        lag = np.diff(at)
        seed = (rank[at[1:]] == rank[at[:-1]]) & (lag > least) & (lag <= gram)
        lags, places = lag[seed], at[:-1][seed]
        order = np.lexsort((places, lags))
        lags, places = lags[order], places[order]
        follows = np.concatenate([[False], (np.diff(lags) == 0) & (np.diff(places) == 1)])[: len(lags)]
        covered: dict[int, int] = {}
        for q, i in zip(lags[~follows].tolist(), places[~follows].tolist(), strict=True):
            if i < covered.get(q, 0):
                continue
            left = _agree(word[:i][::-1], word[: i + q][::-1])
            right = gram + _agree(word[i + gram :], word[i + gram + q :])
            start, length = i - left, left + right + q
            covered[q] = i + right
            if length >= max(min_words, min_exponent * q):
                found.append((start, length, q))
        if gram * min_exponent > n:
            break
        gram, least = 2 * gram, gram
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that lie in no run behind its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def with_runs(docs: DataFrame, out: str = "periodic", min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """docs with a struct column: n_words, runs (start, length, period), and the text without repeats."""
    if min_words < 2 or min_exponent < 3:
        raise ValueError("runs have two words or more and at least three periods")
    ship_package(docs.sparkSession)

    @F.pandas_udf(MARKED)
    def mark(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for text in s:
                words = (text or "").encode("utf-8", "surrogatepass").split()
                runs = runs_of(words, min_words, min_exponent)
                kept = b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass")
                rows.append((len(words), [{"start": a, "length": n, "period": q} for a, n, q in runs], kept))
            yield pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])

    return docs.withColumn(out, mark("text"))


def collapse_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """docs whose texts with runs have each of them cut to its first period; other texts stay as they are."""
    (at,) = free(docs, "periodic")
    marked = with_runs(docs, at, min_words, min_exponent)
    return marked.withColumn("text", F.when(F.size(f"{at}.runs") > 0, F.col(f"{at}.collapsed")).otherwise(F.col("text"))).drop(at)


def greatest_run(runs: Column) -> Column:
    """The run of greatest length/period, compared as whole numbers; of equal ones the first."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r.length * best.period > best.length * r.period), r).otherwise(best))


def _looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of ids whose crc32 is a multiple of 10, the words from a on are those of the first p of them over and over."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    d = docs.select("doc_id", "text", F.when(id_remainder(10) == 0, words_of(F.col("text"))).alias("w"), F.floor(h / 10).alias("g"))
    d = d.withColumn("n", F.size("w").cast("long"))
    d = d.withColumn("a", F.expr("cast(if(n > 0, g % n, 0) as int)")).withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)"))
    again = "slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, cast(n - a as int))"
    return d.select("doc_id", F.expr(f"if(n > 0, array_join(concat(slice(w, 1, a), {again}), ' '), text)").alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_runs(_looped(table(spark, sf_dir, "documents"))).select("doc_id", "periodic.*").withColumn("best", greatest_run(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def oracle() -> str:
    """The same in SQL: equal eight-word grams of one document, stretches of them at each lag, and of
    stretches those that no run of a shorter period holds."""
    return r"""WITH RECURSIVE shape AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda s, x: xor(s >> 8, list_reduce([xor(s, x) & 255, 0, 1, 2, 3, 4, 5, 6, 7], lambda v, k: xor(v >> 1, (v & 1) * 3988292384)))), 4294967295) AS h FROM documents),
cut AS (SELECT doc_id, r, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS turned, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM shape),
said AS (SELECT doc_id, r, n, CASE WHEN turned THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM cut),
word AS (SELECT r, unnest(w) AS word, unnest(range(n)) AS i FROM said),
num AS (SELECT r, i, dense_rank() OVER (ORDER BY word) AS k FROM word),
g2 AS (SELECT *, hash(k, lead(k) OVER o, lead(k, 2) OVER o, lead(k, 3) OVER o, lead(k, 4) OVER o, lead(k, 5) OVER o, lead(k, 6) OVER o, lead(k, 7) OVER o) AS eight, lead(k, 7) OVER o IS NOT NULL AS whole FROM num WINDOW o AS (PARTITION BY r ORDER BY i)),
same AS (SELECT x.r, x.i, y.i - x.i AS q FROM g2 x JOIN g2 y ON x.r = y.r AND x.eight = y.eight AND y.i > x.i WHERE x.whole AND y.whole),
isle AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS b FROM same),
near AS (SELECT r, q, min(i) AS s, max(i) - min(i) + 8 + q AS l FROM isle GROUP BY r, q, b HAVING max(i) - min(i) + 8 + q >= greatest(24, 3 * q)),
runs AS (SELECT * FROM near x WHERE NOT EXISTS (SELECT 1 FROM near y WHERE y.r = x.r AND y.q < x.q AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
best AS (SELECT r, s AS start, l AS length, q AS period FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY CAST(l AS DECIMAL(38,18)) / q DESC, s, q) = 1),
listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
left_ AS (SELECT w.r, string_agg(word, ' ' ORDER BY w.i) AS kept FROM word w LEFT JOIN gone g ON g.r = w.r AND g.i = w.i WHERE g.r IS NULL GROUP BY w.r)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM said d LEFT JOIN best b ON b.r = d.r LEFT JOIN listed l ON l.r = d.r LEFT JOIN left_ k ON k.r = d.r"""
