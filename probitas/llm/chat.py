"""Chat formatting in budgeted windows.

A turn's tokens are its words and a fixed charge for its marks, or what a column of the table says
(token_files.with_token_counts() gives one of a tokenizer's counts). Prefix sums over a conversation's
turns (system turn left out) cut it into spans of whole turns: with F tokens for fresh turns, a
turn belongs to window 2k, k being the tokens before it divided by F, or to window 2k + 1 if it
runs over the end of its span, so no window has more than F fresh tokens unless one turn alone
has. The system turn stands again at the head of every later window, and turns from the end of a
span, of at most H tokens, stand again as history in the next window. Repeated turns are
left out of the loss, so each assistant text is a target once.

The budget holds system turn, history and fresh turns: with S tokens for the system turn, a quarter
of the budget is kept for fresh turns, H is what S leaves of the other three, `HISTORY` at most, and
F is the rest. So a window is above the budget only if it has one fresh turn, which is too long. A
system turn of more than three quarters is not repeated but dealt like any other turn.

Prefix sums go in two steps, over blocks of `BLOCK` turn numbers and within them, and windows are
assembled by (conversation, window), so that a conversation with most of the rows is dealt over
many tasks.

In the output a turn is <|im_start|>role, newline, text, <|im_end|>, newline. Control strings
within texts are escaped by a backslash after their first character, backslashes are doubled.

Defined results: a null text or role is the empty string; rows are ordered by turn (null first),
role and text; repeated rows are turns each; a null conv_id is a conversation of its own; only a first row with role
system counts as the system turn; an empty table gives an empty result; texts of any length stay
whole; other columns, whatever their names, change nothing; a null token count is 0.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from probitas.cluster import ship_package
from probitas.llm.common import n_words, table

BUDGET, HISTORY, MARKS, BLOCK = 1024, 256, 4, 256
START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common templates; the first character stays, a backslash follows it.
CONTROL = r"(<)(\||/?s>|</?SYS>>|/SYS>>|start_of_turn>|end_of_turn>)|(\[)(/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$3\\$2$4")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text) if "\\" in text else text


def unescape_role(role: str) -> str:
    return re.sub(r"(?s)\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role) if "\\" in role else role


def _ordered(turns: DataFrame, tokens: str | None) -> DataFrame:
    """turns with conv_id, turn, role and text, nulls replaced, their tokens, and the block's key:
    c0 and c1 stand for conv_id and are never null, so that one exchange serves windows and joins."""
    n = n_words(F.col("text")) + MARKS if tokens is None else F.coalesce(F.col(tokens), F.lit(0)).cast("long")
    d = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), n.alias("tokens"))
    return d.withColumns({"c0": F.col("conv_id").isNull(), "c1": F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "block": F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62)))})


def _blocks(d: DataFrame, budget: int, history: int) -> DataFrame:
    """A row a block: base and top, the fresh tokens before it and up to its end; opens, whether it
    is its conversation's first; head, the system turn, and sys, its tokens; hist, the tokens that
    history may have; fresh, those of a span."""
    g = d.groupBy("c0", "c1", "block").agg(F.any_value("conv_id").alias("conv_id"), F.sum("tokens").alias("n"), F.min(F.struct("turn", "role", "text", "tokens")).alias("h"))
    along = Window.partitionBy("c0", "c1").orderBy("block")
    before = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = g.select("*", before.alias("before"), (F.row_number().over(along) == 1).alias("opens"), F.first("h").over(along).alias("top_turn"))
    repeat = (F.col("top_turn.role") == "system") & (F.col("top_turn.tokens") <= budget - budget // 4)
    g = g.withColumn("head", F.when(repeat, F.col("top_turn"))).withColumn("sys", F.coalesce("head.tokens", F.lit(0)))
    g = g.withColumn("base", F.col("before") - F.when(F.col("opens"), 0).otherwise(F.col("sys"))).withColumn("top", F.col("before") + F.col("n") - F.col("sys"))
    g = g.withColumn("hist", F.least(F.lit(history), F.lit(budget - budget // 4) - F.col("sys")))
    return g.withColumn("fresh", F.lit(budget) - F.col("sys") - F.col("hist"))


def with_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: str | None = None) -> DataFrame:
    """(conv_id, window, place, turn, role, text, again): every turn where it is fresh, and its
    repeats; place is 0 for the system turn, 1 for history and 2 for fresh turns. The system turn is
    given to all windows that the sums allow; those without fresh turns are left out by formatted()."""
    d = _ordered(turns, tokens)
    blocks = _blocks(d, budget, history)
    order = Window.partitionBy("c0", "c1", "block").orderBy("turn", "role", "text")
    inner = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.select("*", inner.alias("inner"), F.row_number().over(order).alias("nth"))
    d = d.join(blocks.select("c0", "c1", "block", "base", "opens", F.col("head").isNotNull().alias("led"), "sys", "hist", "fresh"), ["c0", "c1", "block"])
    d = d.withColumn("head", F.col("opens") & F.col("led") & (F.col("nth") == 1)).withColumn("value", F.when(F.col("head"), 0).otherwise(F.col("tokens")))
    d = d.withColumn("p", F.col("base") + F.col("inner") - F.when(F.col("opens") & (F.col("nth") > 1), F.col("sys")).otherwise(0))
    d = d.withColumn("q", F.col("p") + F.col("value")).withColumn("k", F.floor(F.col("p") / F.col("fresh")))
    end = (F.col("k") + 1) * F.col("fresh")
    over = (F.col("p") > F.col("k") * F.col("fresh")) & (F.col("q") > end)
    at = lambda place, window, again: F.struct(F.lit(place).alias("place"), window.alias("window"), F.lit(again).alias("again"))
    own = F.when(F.col("head"), at(0, F.lit(0).cast("long"), False)).otherwise(at(2, 2 * F.col("k") + over.cast("long"), False))
    later = F.when(over & (F.col("tokens") <= F.col("hist")), at(1, 2 * F.floor(F.col("q") / F.col("fresh")), True)).when(~over & ~F.col("head") & (F.col("p") >= end - F.col("hist")), at(1, 2 * F.col("k") + 1, True))
    rows = d.select("conv_id", "turn", "role", "text", F.explode(F.array_compact(F.array(own, later))).alias("at")).select("conv_id", "turn", "role", "text", "at.*")
    up = lambda c: F.floor((F.col(c) + F.col("fresh") - 1) / F.col("fresh"))
    heads = blocks.filter("head is not null").withColumns({"k0": up("base"), "k1": up("top") - 1}).filter("k1 >= k0")
    heads = heads.select("conv_id", "head.turn", "head.role", "head.text", F.explode(F.sequence("k0", "k1")).alias("k"))
    heads = heads.select("conv_id", "turn", "role", "text", F.explode(F.array(2 * F.col("k"), 2 * F.col("k") + 1)).alias("window")).filter("window > 0")
    return rows.unionByName(heads.withColumns({"place": F.lit(0), "again": F.lit(True)}))


def formatted(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: str | None = None) -> DataFrame:
    """(conv_id, window, text, n_again, loss_spans): one row a window that has fresh turns; the
    first n_again turns of text are repeats; loss_spans are the (start, end) in characters of the
    fresh assistant texts. tokens names a column of turns that counts their tokens, marks included."""
    turn = F.struct("place", "turn", "role", "text", "again")
    g = with_windows(turns, budget, history, tokens).groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.bool_or(~F.col("again")).alias("any"))
    segs = F.transform("turns", lambda x: F.struct(F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n")).alias("a"), escape(x["text"]).alias("b"), ((x["role"] == "assistant") & ~x["again"]).alias("loss"), x["again"].alias("again")))
    g = g.filter("any").select("conv_id", "window", segs.alias("segs"))
    close = len(END) + 1
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["a"])
        end = start + F.length(x["b"])
        return F.struct((end + close).alias("at"), F.when(x["loss"], F.array_append(s["spans"], F.struct(start.alias("start"), end.alias("end")))).otherwise(s["spans"]).alias("spans"))

    text = F.array_join(F.transform("segs", lambda x: F.concat(x["a"], x["b"], F.lit(END + "\n"))), "")
    n_again = F.size(F.filter("segs", lambda x: x["again"]))
    return g.select("conv_id", "window", text.alias("text"), n_again.alias("n_again"), F.aggregate("segs", empty, add, lambda s: s["spans"]).alias("loss_spans"))


def parse(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a window's text, unescaped."""
    out = []
    for seg in text.split(END + "\n")[:-1]:
        role, _, said = seg.removeprefix(START).partition("\n")
        out.append((unescape_role(role), unescape(said)))
    return out


class _Digest:
    """What is read back of one conversation, window after window."""

    def __init__(self):
        self.turns, self.loss, self.n_turns, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, text: str, n_again: int, spans: list[dict]) -> None:
        self.chars += len(text)
        for role, said in parse(text)[n_again:]:
            self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
        for s in spans:
            part = unescape(text[s["start"] : s["end"]])
            self.loss.update(part.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(part)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from formatted()'s
    rows. A digest runs along a conversation, so its windows stream through one task, one at a time."""
    ship_package(windows.sparkSession)
    kinds = [("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())]
    schema = T.StructType([windows.schema["conv_id"], *(T.StructField(n, k) for n, k in kinds)])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, d = None, None
        for b in batches:
            out = []
            for conv, text, n_again, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "n_again", "loss_spans")), strict=True):
                if d is None or conv != now:
                    if d is not None:
                        out.append((now, *d.row()))
                    now, d = conv, _Digest()
                d.add(text, n_again, spans)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        if d is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((now, *d.row()), arrow, strict=True)], schema=arrow)

    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(digest, schema)


_EXTRA = "</s>[INST] ok [/INST]"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", _EXTRA), (-7, 1, "assistant", _EXTRA)], turns.schema)
    return read_back(formatted(turns.union(more)))


def oracle() -> str:
    control = CONTROL.replace("'", "''")
    esc = lambda c: f"regexp_replace(replace({c}, '\\', '\\\\'), '{control}', '\\1\\3\\\\\\2\\4', 'g')"
    marks = len(START) + len(END) + 2
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_EXTRA}' UNION ALL SELECT -7, 1, 'assistant', '{_EXTRA}'),
a AS (SELECT *, len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) + {MARKS} AS tokens,
        {marks} + length({esc("text")}) + length(replace({esc("role")}, chr(10), '\\n')) AS chars,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) = 1 AND role = 'system' AND tokens <= {BUDGET - BUDGET // 4} AS head FROM t),
b AS (SELECT *, CASE WHEN head THEN 0 ELSE tokens END AS value, max(CASE WHEN head THEN tokens END) OVER (PARTITION BY conv_id) AS sys, max(CASE WHEN head THEN chars END) OVER (PARTITION BY conv_id) AS sys_chars FROM a),
c AS (SELECT *, least({HISTORY}, {BUDGET - BUDGET // 4} - coalesce(sys, 0)) AS hist, {BUDGET} - coalesce(sys, 0) - least({HISTORY}, {BUDGET - BUDGET // 4} - coalesce(sys, 0)) AS fresh,
        coalesce(sum(value) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM b),
d AS (SELECT *, p + value AS q, CAST(p // fresh AS BIGINT) AS k FROM c),
e AS (SELECT *, p > k * fresh AND q > (k + 1) * fresh AS over_ FROM d),
f AS (SELECT *, CASE WHEN head THEN 0 ELSE 2 * k + CAST(over_ AS BIGINT) END AS win FROM e),
w AS (SELECT DISTINCT conv_id, win FROM f),
h AS (SELECT conv_id, chars, CASE WHEN over_ THEN 2 * CAST(q // fresh AS BIGINT) ELSE 2 * k + 1 END AS win FROM f
      WHERE (over_ AND tokens <= hist) OR (NOT over_ AND NOT head AND p >= (k + 1) * fresh - hist)),
n AS (SELECT conv_id, chars FROM f UNION ALL SELECT h.conv_id, h.chars FROM h JOIN w ON h.conv_id = w.conv_id AND h.win = w.win),
s AS (SELECT w.conv_id, sum(m.sys_chars) AS chars FROM w JOIN (SELECT conv_id, max(sys_chars) AS sys_chars FROM f GROUP BY conv_id) m ON w.conv_id = m.conv_id WHERE w.win > 0 GROUP BY w.conv_id),
g AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS chars FROM n GROUP BY conv_id)
SELECT a.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(any_value(g.chars) + coalesce(any_value(s.chars), 0) AS BIGINT) AS formatted_chars
FROM a JOIN g ON a.conv_id = g.conv_id LEFT JOIN s ON a.conv_id = s.conv_id GROUP BY a.conv_id"""
