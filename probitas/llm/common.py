"""Columns and jobs that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probitas.cluster import scratch, stage

#: White space that parts words, everywhere in this subpackage; bytes.split() parts at the same.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many leading underscores as it takes to be no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def all_of(df: DataFrame, *without: str) -> list[Column]:
    """The columns of df, whatever their names, but for those of the given names."""
    gone = {c.lower() for c in without}
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in gone]


def text_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells rows apart, never null: whether the id is null, the id, and the text's hash."""
    return F.struct(F.isnull(doc_id).alias("none"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("i"), F.xxhash64(text).alias("h"))


def without_rows(docs: DataFrame, gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs without the rows whose text_key() is in gone (key), and one of each that is in repeated
    (key). Rows of other keys stay where they are read unless gone is too large to send around."""
    at, n = free(docs, "key_", "n_")
    keyed = docs.withColumn(at, text_key())
    rest = keyed.join(gone.union(repeated).toDF(at), at, "left_anti").select(*all_of(docs))
    if repeated.isEmpty():
        return rest
    many = keyed.join(repeated.toDF(at), at, "left_semi").withColumn(n, F.row_number().over(Window.partitionBy(at).orderBy(F.lit(0))))
    return rest.union(many.filter(F.col(n) == 1).select(*all_of(docs)))


def one_of_each(docs: DataFrame, groups: DataFrame, label: str) -> DataFrame:
    """docs with one row of each group; groups (doc_id, text_hash, label) has a row for each row of
    docs. The row of least doc_id stays, of rows that share that id the one of least text hash, of
    full repeats any one; a null id stays only if the group has no other. groups is read twice."""
    key = lambda d: F.struct(F.isnull("doc_id").alias("none"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), d.alias("h")).alias("key")
    first = groups.groupBy(label).agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash")).alias("x")).select("x.doc_id", "x.text_hash")
    kept = first.select(key(F.col("text_hash")), F.lit(True).alias("kept"))
    marks = groups.select(key(F.col("text_hash"))).groupBy("key").agg(F.count("*").alias("n")).join(kept, "key", "left")
    marks = stage(marks.filter("kept is null or n > 1"), "marks")
    return without_rows(docs, marks.filter("kept is null").select("key"), marks.filter("kept").select("key"))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null, empty or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.size(words_of(text)).cast("long")


def lower_az(text: Column) -> Column:
    """A-Z to a-z, other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_remainder(m: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % m


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) of the graph of edges (a, b), both long; component is the least node.

    Alternating large-star and small-star rounds: every round is two aggregations and two joins
    over the edges, written to the shared folder; a star of any size is pre-aggregated and its
    join can be split, so no group meets in one task. Ends when a round changes nothing. Nodes
    without an edge to another node don't appear; repeated edges and loops change nothing.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))

    def check(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    with scratch(edges.sparkSession) as keep:
        e = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
        before = check(e)
        for _ in range(max_rounds):
            if not before[0]:
                break
            s = both(e)
            least = s.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = s.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
            e = stage(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
            after = check(e)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        return keep(e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct()), "components")
