"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Base spans are exact patterns and always stay. Candidates are the base spans and what looser
patterns find besides them: written-out or non-ASCII addresses, IPv6, numbers of other lengths
or inside longer runs of digits, telephone numbers without a plus. On each candidate, labelers of
three kinds vote yes (1), no (-1) or not at all (0): patterns of the span itself, gazetteers
(top-level domains, reserved networks, card issuers, calling codes), and the context (words before
the span, characters beside it). Votes are counted over all documents by vote vector, at most
3^`len(LABELERS)` for each kind of data. Expectation-maximisation over these counts estimates how
often each labeler is right when it votes, and so how likely a vote vector is personal data; not
voting says nothing. A logistic regression for each kind then learns those likelihoods from
features of span and context, on at most about `max_rows` candidates of least hash, and decides on
every candidate that isn't a base span. Which votes came from the base pattern is no feature, so
what it learns carries over to other spans.

Scans take time in proportion to the text: patterns start at signs that cannot repeat inside a
match, or have bounded parts.

Defined results: null, empty and blank texts have no spans; repeated rows are judged each; null
ids are kept; base spans of one kind don't overlap, spans of different kinds may; an added span
overlaps no other span of its kind (the likelier stays, then the earlier); without candidates
nothing is trained; an empty table gives an empty result; other columns, whatever their names,
change nothing; offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from probitas.cluster import scratch, ship_package, stage
from probitas.llm.common import table

KINDS = ("email", "ip", "card", "phone")
#: Candidates of a kind that the classifier learns from, about; cells of its features; what it accepts.
MAX_ROWS, CELLS, THRESHOLD = 4096, 1 << 12, 0.5
#: Votes when labelers are unknown: how often one is right, and how many votes that belief weighs.
RIGHT, BELIEF = 0.8, 10.0

# Gazetteers and context words.
DOMAINS = "com org net edu gov mil int info biz io co de fr es it nl be at ch uk ie us ca au nz in jp cn kr br mx ar cl pt pl cz se no fi dk ru ua gr tr eu example test".split()
FILES = "png jpg jpeg gif svg js css html htm php py java txt pdf zip gz exe dll json xml csv mp3 mp4".split()
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
YES = {
    "email": "mail email e-mail contact write reach address courriel correo mailto kontakt",
    "ip": "ip host server address login client from peer gateway dns adresse",
    "card": "card visa mastercard amex credit debit payment pay carte karte tarjeta",
    "phone": "call phone tel telephone mobile cell fax dial whatsapp contact telefon telefono téléphone appelez",
}
NO = {
    "email": "package version import npm commit decorator",
    "ip": "version v release build section chapter firmware ver",
    "card": "hash order id isbn serial tracking token number sha invoice ticket",
    "phone": "hash order id isbn serial tracking version token date invoice ticket page lines",
}

_BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_AFTER_AT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY_EMAIL = re.compile(r"[^\s@<>()\[\]{},;:\"']{1,64}@[^\s@<>()\[\]{},;:\"']{1,190}")
_SPELLED = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?[\[({<] ?at ?[\])}>] ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({<] ?dot ?[\])}>] ?| dot )[A-Za-z0-9-]{1,63}){1,6}", re.IGNORECASE)
_V6 = re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:(?::?[0-9A-Fa-f]{1,4}:){1,6}:?[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}::[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:])")
_SPLIT_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]) ?[0-9]{1,3}){3}(?![0-9.])")
_GROUPS = re.compile(r"[0-9]+(?:[ .-][0-9]+)*")
_PHONE = re.compile(r"(?<![\w+.-])(?:00[1-9][0-9]{0,2}[ .-]|\([0-9]{2,5}\) ?|0[0-9]{1,4}[ /-]|[0-9]{3}[ .-](?=[0-9]{3}[ .-][0-9]{4}))[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![\w-])")
_PLUS_PART = re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")
_AT_SIGN = re.compile(r"[\[({<] ?at ?[\])}>]", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) < 4 and int(s or 0) <= 255


def emails(text: str) -> list[Span]:
    """Leftmost addresses: the run of name characters before each @, as far as it is free, and the domain behind."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        name = _BEFORE_AT.search(text, max(free, at - 64), at)  # looks back further only where the name is longer
        if name and name.start() == at - 64 > free:
            start = at
            while start > free and _BEFORE_AT.match(text[start - 1]):
                start -= 1
        else:
            start = name.start() if name else at
        domain = _AFTER_AT.match(text, at + 1)
        if start < at and domain:
            found.append((start, domain.end()))
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    return found


def base_spans(text: str) -> dict[str, list[Span]]:
    """The spans of each kind's exact pattern; matches that fail the kind's test are dropped."""
    ips = [m.span() for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    cards = [m.span() for m in _DIGITS.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in _PLUS.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return {"email": emails(text), "ip": ips, "card": cards, "phone": phones}


def _card_windows(text: str) -> Iterator[Span]:
    """Groups of at least three digits, one or more side by side, that hold 13 to 19 digits; of those with
    one start the shortest with a right check digit, else the shortest."""
    for m in _GROUPS.finditer(text):
        if m.end() - m.start() < 13:
            continue
        groups = [(g.start() + m.start(), g[0]) for g in re.finditer("[0-9]+", m[0])]
        for i, (start, _) in enumerate(groups):
            digits, fits = "", []
            for at, g in groups[i : i + 6]:
                digits += g if len(g) > 2 else "0" * 20
                if len(digits) > 19:
                    break
                if len(digits) >= 13:
                    fits.append((not luhn(digits), at + len(g)))
            if fits:
                yield start, min(fits)[1]


def more_spans(text: str) -> dict[str, list[Span]]:
    """What looser patterns find; spans of a kind may overlap each other and base spans."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        for m in _ANY_EMAIL.finditer(text):
            end = m.start() + len(m[0].rstrip(".!?*#%$&-_"))
            if "." in text[m.start() : end].rpartition("@")[2]:
                found["email"].append((m.start(), end))
    if _AT_SIGN.search(text):
        found["email"] += [m.span() for m in _SPELLED.finditer(text)]
    if ":" in text:
        found["ip"] += [m.span() for m in _V6.finditer(text) if not re.fullmatch(r"[0-9]{1,2}(?::[0-9]{2}){1,2}", m[0])]
    if "[" in text or "(" in text:
        found["ip"] += [m.span() for m in _SPLIT_IP.finditer(text) if all(map(_octet, re.findall("[0-9]+", m[0])))]
    found["card"] += _card_windows(text)
    found["phone"] += [m.span() for p in (_PHONE, _PLUS_PART) for m in p.finditer(text) if 7 <= len(_digits(m[0])) <= 15]
    return found


# Labelers: (kind, span's text, words before it, character before, character behind, is base) -> vote.


def by_base(kind: str, s: str, words: list[str], left: str, right: str, base: bool) -> int:
    return 1 if base else 0


def by_shape(kind: str, s: str, words: list[str], left: str, right: str, base: bool) -> int:
    d = _digits(s)
    if kind == "email":
        return 1 if re.search(r"[A-Za-z]{2,24}\Z", s) else -1
    if kind == "ip":
        return -1 if re.fullmatch(r"[0-9](?:\.[0-9]){3}", s) else 1 if "." in s or s.count(":") > 2 else 0
    if kind == "card":
        return 1 if luhn(d) else -1
    return -1 if re.fullmatch(r"(?:19|20)[0-9]{2}[.-][01]?[0-9][.-][0-3]?[0-9].*", s) or len(set(d)) == 1 else 1 if len(d) >= 9 and ("(" in s or s[0] == "+" and re.search("[ .-]", s)) else 0


def by_gazetteer(kind: str, s: str, words: list[str], left: str, right: str, base: bool) -> int:
    d = _digits(s)
    if kind == "email":
        last = _WORD.findall(s.lower())[-1:]
        return 1 if last and last[0] in DOMAINS else -1 if last and last[0] in FILES else 0
    if kind == "ip":
        first = re.match("[0-9]+", s)
        return 0 if ":" in s or not first else -1 if int(first[0][-3:]) in (0, 127) else 1
    if kind == "card":
        issued = d[0] in "45" or d[:2] in ("34", "37", "35", "36", "38", "60", "65", "62") or 2221 <= int(d[:4]) <= 2720
        return 1 if issued and len(d) in (14, 15, 16, 19) else 0 if len(d) == 16 else -1
    return 1 if s[0] == "+" and any(d.startswith(c) for c in CODES) or s[:2] == "00" else 0


def by_words(kind: str, s: str, words: list[str], left: str, right: str, base: bool) -> int:
    near = set(words[-3:])
    return 1 if near & _YES[kind] else -1 if near & _NO[kind] else 0


def by_sides(kind: str, s: str, words: list[str], left: str, right: str, base: bool) -> int:
    return -1 if left.isalnum() or right.isalnum() or left in ("_", "=", "/", "#") or right in ("_", "=") else 0


_YES, _NO = ({k: set(v.split()) for k, v in d.items()} for d in (YES, NO))
LABELERS = (by_base, by_shape, by_gazetteer, by_words, by_sides)


def _features(kind: str, s: str, words: list[str], left: str, right: str, votes: list[int]) -> list[int]:
    """Cells of what tells about a span: its shape, ends, neighbours, and what the labelers but the base pattern say."""
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: str(min(9, len(m[0]))), s))[:32]
    sides = "".join("a" if c.isalpha() else "9" if c.isdigit() else "_" if c.isspace() or not c else c for c in (left, right))
    said = [f"shape {shape}", f"first {s[:1]}", f"last {s[-3:].lower()}", f"sides {sides}", f"digits {len(_digits(s))}", f"length {len(s) // 4}", f"before {words[-1] if words else ''}"]
    said += [f"vote {i} {v}" for i, v in enumerate(votes) if i]
    return [zlib.crc32(f"{kind} {x}".encode("utf-8", "surrogatepass")) % CELLS for x in said]


def candidates(text: str) -> list[tuple[int, int, int, bool, int, list[int]]]:
    """(kind, start, end, is base, votes, features) of every candidate; votes are digits to base 3."""
    base, more, out = base_spans(text), more_spans(text), []
    for k, kind in enumerate(KINDS):
        own = base[kind]
        spans = [(s, e, True) for s, e in own]
        starts = np.array([s for s, _ in own], dtype=np.int64)
        for s, e in sorted(set(more[kind])):
            i = int(np.searchsorted(starts, e))  # the last base span that starts before the end
            if not (i and own[i - 1][1] > s):
                spans.append((s, e, False))
        for s, e, is_base in spans:
            words = [w.lower() for w in _WORD.findall(text[max(0, s - 60) : s])]
            args = (kind, text[s:e], words, text[s - 1 : s] if s else "", text[e : e + 1])
            votes = [f(*args, is_base) for f in LABELERS]
            packed = 0
            for v in votes:
                packed = packed * 3 + v + 1
            out.append((k, s, e, is_base, packed, _features(*args, votes)))
    return out


def votes_of(packed: int) -> list[int]:
    out = []
    for _ in LABELERS:
        out.append(packed % 3 - 1)
        packed //= 3
    return out[::-1]


def label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote vectors (rows) and how often each came: (likelihood of yes for each vector,
    how often each labeler that votes is right for yes and for no, share of yes)."""
    yes, no = votes == 1, votes == -1
    right = np.full((2, votes.shape[1]), RIGHT)
    share = 0.5
    for _ in range(rounds):
        log_yes = np.log(share) + yes @ np.log(right[0]) + no @ np.log(1 - right[0])
        log_no = np.log(1 - share) + yes @ np.log(1 - right[1]) + no @ np.log(right[1])
        p = 1 / (1 + np.exp(np.clip(log_no - log_yes, -50, 50)))
        a, b = counts * p, counts * (1 - p)
        now = np.stack([(a @ yes + BELIEF * RIGHT) / (a @ (yes | no) + BELIEF), (b @ no + BELIEF * RIGHT) / (b @ (yes | no) + BELIEF)])
        share, moved = (a.sum() + BELIEF / 2) / (counts.sum() + BELIEF), np.abs(now - right).max()
        right = now
        if moved < 1e-9:
            break
    return p, right, float(share)


def train_classifier(features: list[list[int]], target: np.ndarray, rounds: int = 60, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression on cells with soft targets: full-batch steps scaled by each cell's past gradients."""
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    cells = np.array([c for f in features for c in f], dtype=np.int64)
    w, past = np.zeros(CELLS + 1), np.full(CELLS + 1, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(w[CELLS] + np.bincount(rows, w[cells], minlength=len(features)))))
        wrong = (p - target) / len(features)
        g = np.concatenate([np.bincount(cells, wrong[rows], minlength=CELLS), [wrong.sum()]]) + decay * w
        past += g * g
        w -= rate * g / np.sqrt(past)
    return w


def _likelihood(features: list[int], w: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-(w[CELLS] + w[features].sum()))))


def chosen(scored: list[tuple], threshold: float) -> list[tuple]:
    """Of (kind, start, end, is base, score): base spans, and the likeliest of others that overlap none of their kind."""
    taken: list[list[Span]] = [[] for _ in KINDS]
    kept = [c for c in scored if c[3]]
    for c in kept:
        insort(taken[c[0]], (c[1], c[2]))
    for c in sorted((c for c in scored if not c[3] and c[4] >= threshold), key=lambda c: (-c[4], c[1], -c[2])):
        i = bisect_left(taken[c[0]], (c[2], 0))  # what stands before starts before the span's end
        if not (i and taken[c[0]][i - 1][1] > c[1]):
            taken[c[0]].insert(i, (c[1], c[2]))
            kept.append(c)
    return sorted(kept, key=lambda c: c[:3])


CANDIDATES = "found array<struct<kind:int,start:int,end:int,base:boolean,votes:int,features:array<int>>>"


def find_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, found), a row for each row of docs (doc_id, text)."""
    ship_package(docs.sparkSession)
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(CANDIDATES).fields])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in schema["found"].dataType.elementType.fields]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(names, c, strict=True)) for c in candidates(t or "")] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(arrow.field(0).type), pa.array(found, arrow.field(1).type)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(of, schema)


def learn(found: DataFrame, max_rows: int = MAX_ROWS) -> dict[int, np.ndarray]:
    """Weights of each kind's classifier from all candidates' votes and a bounded number of their features."""
    each = found.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.*")
    vectors = each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()  # 4 * 3^labelers rows at most
    likely, weights = {}, {}
    for kind in {v.kind for v in vectors}:
        mine = sorted((v.votes, v.n) for v in vectors if v.kind == kind)
        p, _, _ = label_model(np.array([votes_of(v) for v, _ in mine]), np.array([n for _, n in mine], dtype=float))
        likely |= {(kind, v): x for (v, _), x in zip(mine, p.tolist(), strict=True)}
    total = {k: sum(v.n for v in vectors if v.kind == k) for k in {v.kind for v in vectors}}
    share = F.create_map(*(F.lit(x) for k, n in total.items() for x in (k, min(1.0, max_rows / n)))) if total else F.lit(None)
    chance = (F.pmod(F.xxhash64("doc_id", "kind", "start", "features"), F.lit(1 << 30)) / (1 << 30)).alias("r")
    # about max_rows of each kind; whole copies of a row share their hash
    some = each.filter(chance < share[F.col("kind")]).select("kind", "votes", "features").groupBy("kind", "votes", "features").agg(F.count("*").alias("n")).orderBy("kind", "votes", "features").collect() if total else []
    for kind in total:
        mine = [r for r in some if r.kind == kind]
        if mine:
            weights[kind] = train_classifier([r.features for r in mine], np.array([likely[kind, r.votes] for r in mine]))
    return weights


def find_private(docs: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, spans), a row for each row of docs (doc_id, text): spans (kind, start, end, base, score) by
    kind as in KINDS, then start. Base spans have their score, too, but stay whatever it is."""
    found = stage(find_candidates(docs), "candidates")
    weights = docs.sparkSession.sparkContext.broadcast(learn(found, max_rows))

    @F.pandas_udf("array<struct<kind:string,start:long,end:long,base:boolean,score:double>>")
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        none = np.zeros(CELLS + 1)
        for s in batches:
            out = []
            for row in s:
                scored = [(c["kind"], c["start"], c["end"], c["base"], _likelihood(list(c["features"]), weights.value.get(c["kind"], none))) for c in row]
                out.append([dict(zip(("kind", "start", "end", "base", "score"), (KINDS[c[0]], *c[1:]), strict=True)) for c in chosen(scored, threshold)])
            yield pd.Series(out, dtype=object)

    return found.select("doc_id", decide("found").alias("spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as keep:
        d = find_private(table(spark, sf_dir, "documents")).withColumn("by_pattern", F.filter("spans", lambda x: x.base))
        n = [F.expr(f"cast(size(filter(by_pattern, x -> x.kind = '{k}')) as long) as n_{k}") for k in KINDS]
        digest = F.sha2(_written(F.col("by_pattern")).cast("binary"), 256).alias("base_sha256")
        return keep(d.select("doc_id", *n, digest, _written(F.col("spans")).alias("spans")), "private")
