"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects a document whose ratio is above a cutoff of a fixed grid. The rules are tightened
one after another along a path that is fixed before any label is read: every rule to its loosest
cutoff, then every rule to the next one, and so on. What a step of the path rejects, all later
steps reject too. Whether a step is safe is tested on labelled documents: in a stratum with n good
ones, k of which the step would reject, the exact binomial tail P(Bin(n, alpha) <= k) is a p-value
for "this step rejects at least a share alpha of good documents".

Multiple testing: within a stratum the steps are tested in the path's order and the testing ends
with the first one whose p-value is above delta / strata (fixed sequence: as a test is made only
if all before it succeeded, steps share one error rate), and over strata the rate is split evenly
(Bonferroni). With confidence 1 - delta, all strata together, the steps so certified reject less
than alpha of the good documents that pass the base rule. Good documents that the base rule
rejects come on top, as it is no subject of the tests. Each stratum takes its last certified step.

The stratum is the language. A text that several labelled documents share counts once, as its copies
are no independent draws; near copies still count each.

Defined results: a null or empty text has no words and fails the base rule; a null language is a
stratum of its own; rows without a label (or with a null one) take no part in the tests; of
repeated labels the least counts; repeated documents are judged alike; a stratum without enough
labels certifies nothing and rejects nothing beyond the base rule; a ratio equal to a cutoff is not
above it; an empty table gives an empty result; texts of any length are counted whole; other
columns, whatever their names, change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probitas.cluster import stage
from probitas.llm.common import SPACE, free, table, words_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")
#: rule: numerator and denominator; rejected if 1000 * numerator > cutoff * denominator.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}
#: Cutoffs in thousandths, loosest first.
GRID = (700, 500, 350, 250, 180, 120, 80, 50, 30, 20, 10, 5)
ALPHA, DELTA, MIN_WORDS = 0.05, 0.05, 50
#: Steps of the path: step s sets rule s % rules to cutoff s // rules of the grid.
STEPS = len(RULES) * len(GRID)


def _let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def repeat_words(words: Column, n: int = 3) -> Column:
    """Words in n-word windows that occur twice or more in the array, first occurrences included.

    Windows are hashed to longs whose low 30 bits are replaced by the position; sorting those
    longs brings windows that may be equal together. Only they are then compared by whole hash.
    """
    low = F.lit((1 << 30) - 1).cast("long")
    size = F.size(words)

    def count(hashes: Column) -> Column:
        packed = F.sort_array(F.transform(hashes, lambda h, i: F.shiftrightunsigned(h, 31) * F.lit(1 << 30).cast("long") + i))

        def maybe(p: Column) -> Column:
            top = lambda x: F.shiftrightunsigned(x, 30)
            near = F.filter(p, lambda x, i: (F.coalesce(top(F.get(p, i - 1)) == top(x), F.lit(False))) | F.coalesce(top(F.get(p, i + 1)) == top(x), F.lit(False)))
            return F.array_sort(F.transform(near, lambda x: F.struct(F.get(hashes, x.bitwiseAND(low).cast("int")).alias("h"), x.bitwiseAND(low).alias("at"))))

        def sure(c: Column) -> Column:
            same = F.filter(c, lambda x, i: F.coalesce(F.get(c, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(c, i + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(same, lambda x: x["at"]))

        covered = lambda at: F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-n).cast("long").alias("last")), lambda s, x: F.struct((s["n"] + F.least(F.lit(n).cast("long"), x - s["last"])).alias("n"), x.alias("last")), lambda s: s["n"])
        return _let(packed, lambda p: _let(maybe(p), lambda c: F.when(F.size(c) == 0, F.lit(0).cast("long")).otherwise(_let(sure(c), covered))))

    windows = F.transform(F.slice(words, 1, F.greatest(size - n + 1, F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, n))))
    return F.when(size < n + 1, F.lit(0).cast("long")).otherwise(_let(windows, count))


def with_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_capitals, n_lines, n_dup_lines, n_repeat_words;
    columns of these names are replaced."""
    text = F.coalesce("text", F.lit(""))
    lines_of = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    long = lambda c: c.cast("long")
    words, lines = free(docs, "words", "lines")
    d = docs.withColumns({words: words_of(F.col("text")), lines: lines_of})
    d = d.withColumns({
        "n_words": long(F.size(words)),
        "word_chars": long(F.length(F.regexp_replace(text, SPACE, ""))),
        "n_symbols": long(F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))),
        "n_capitals": long(F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))),
        "n_lines": long(F.size(lines)),
        "n_dup_lines": long(F.size(lines) - F.size(F.array_distinct(lines))),
        "n_repeat_words": repeat_words(F.col(words)),
    })
    return d.drop(words, lines)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def first_step() -> Column:
    """The first step of the path that rejects a counted document, `STEPS` if none does."""
    steps = []
    for i, (num, den) in enumerate(RULES.values()):
        c = F.lit(STEPS)
        for g, cut in reversed(list(enumerate(GRID))):
            c = F.when(1000 * F.col(num) > cut * F.col(den), F.lit(g * len(RULES) + i)).otherwise(c)
        steps.append(c)
    return F.least(*steps)


def binomial_tail(k: Column, n: Column, a: float) -> Column:
    """P(Bin(n, a) <= k), exact, summed as logarithms; 1 if k is above the mean."""
    from math import log

    step = log(a) - log(1 - a)

    def add(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1).cast("double") / i) + F.lit(step)
        top = F.greatest(s["sum"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(s["sum"] - top) + F.exp(term - top))).alias("sum"))

    first = n.cast("double") * F.lit(log(1 - a))
    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.struct(first.alias("term"), first.alias("sum")), add, lambda s: F.exp(s["sum"]))
    return F.when(k > n * a, F.lit(1.0)).otherwise(tail)


def certified_steps(counted: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, n_good, step, cut_<rule>...) of each stratum with labels: its last certified step and
    the cutoffs it sets, null where none is; counted: (doc_id, stratum, text_hash, step, base_failed)."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("least")).filter("least = 1 and doc_id is not null").select("doc_id")
    held = counted.filter("not base_failed").join(good, "doc_id", "left_semi").select("stratum", "text_hash", "step").distinct()
    strata = counted.select("stratum").distinct().count()
    at = held.groupBy("stratum", "step").agg(F.count("*").alias("k"))
    sums = at.groupBy("stratum").agg(F.sum("k").alias("n"), F.map_from_entries(F.collect_list(F.struct("step", "k"))).alias("ks"))  # STEPS + 1 entries at most
    steps = sums.select("stratum", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda s: F.coalesce(F.element_at("ks", s), F.lit(0)))).alias("s", "k"))
    along = Window.partitionBy("stratum").orderBy("s")  # STEPS rows each
    tests = steps.withColumn("sum", F.sum("k").over(along)).withColumn("p", binomial_tail(F.col("sum"), F.col("n"), alpha))
    passed = tests.withColumn("worst", F.max("p").over(along)).filter(F.col("worst") <= F.lit(delta / max(1, strata)))
    last = passed.groupBy("stratum").agg(F.max("n").alias("n_good"), F.max("s").alias("step"))
    cut = lambda i: F.get(F.array(*map(F.lit, GRID)), F.floor((F.col("step") - i) / len(RULES)).cast("int"))
    return last.select("stratum", "n_good", "step", *(F.when(F.col("step") >= i, cut(i)).alias(f"cut_{r}") for i, r in enumerate(RULES)))


def judge_quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """(doc_id, stratum, counts, base_failed, cutoffs, kept), a row for each row of docs."""
    rows = docs.select("doc_id", F.col(stratum).alias("stratum"), "text", F.xxhash64("text").alias("text_hash"))
    counted = stage(with_counts(rows).withColumns({"base_failed": base_failed(), "step": first_step()}).drop("text"), "counts")
    cuts = stage(certified_steps(counted, labels).withColumnRenamed("step", "last_step"), "cutoffs")
    if cuts.count() <= 10_000:  # else Spark shuffles both sides
        cuts = F.broadcast(cuts)
    d = counted.join(cuts.withColumnRenamed("stratum", "of"), F.col("stratum").eqNullSafe(F.col("of")), "left")
    bad = F.coalesce(F.col("step") <= F.col("last_step"), F.lit(False))
    return d.select("doc_id", "stratum", *COUNTS, "base_failed", *(f"cut_{r}" for r in RULES), (~F.col("base_failed") & ~bad).alias("kept"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(f"cut_{r}" for r in RULES))


def oracle() -> str:
    rejected = lambda i, num, den: f"coalesce(len(list_filter({list(GRID)}, lambda c: 1000 * {num} <= c * {den})), 0) * {len(RULES)} + {i}"
    step = f"least({', '.join(rejected(i, *r) for i, r in enumerate(RULES.values()))}, {STEPS})"
    cuts = ", ".join(f"CASE WHEN last_step >= {i} THEN CAST({list(GRID)}[(last_step - {i}) // {len(RULES)} + 1] AS INTEGER) END AS cut_{r}" for i, r in enumerate(RULES))
    return f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
p AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r WHERE n > 1) GROUP BY doc_id),
c0 AS (SELECT w.doc_id, lang, md5(text) AS h, len(ws) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
             length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN p ON w.doc_id = p.doc_id),
c AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {step} AS step FROM c0),
held AS (SELECT DISTINCT lang, h, step FROM c WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
s AS (SELECT l.lang, s, l.n, count(held.step) AS k FROM (SELECT lang, count(*) AS n FROM held GROUP BY lang) l CROSS JOIN range({STEPS}) r(s) LEFT JOIN held ON held.lang IS NOT DISTINCT FROM l.lang AND held.step <= s GROUP BY ALL),
i AS (SELECT lang, s, n, unnest(generate_series(0, CAST(least(k, floor(n * {ALPHA})) AS BIGINT))) AS i, k > n * {ALPHA} AS many FROM s),
v AS (SELECT lang, s, CASE WHEN any_value(many) THEN 1.0 ELSE sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA}))) END AS p FROM i GROUP BY lang, s),
m AS (SELECT lang, s, max(p) OVER (PARTITION BY lang ORDER BY s) AS worst FROM v),
k AS (SELECT lang AS of_lang, max(s) AS last_step FROM m WHERE worst <= {DELTA} / (SELECT count(*) FROM (SELECT DISTINCT lang FROM documents)) GROUP BY lang)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(step <= last_step, FALSE) AS kept, {cuts} FROM c LEFT JOIN k ON c.lang IS NOT DISTINCT FROM k.of_lang"""
