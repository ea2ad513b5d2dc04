"""Personal data by weak supervision, in DataFrame functions only.

Candidates.  Base kinds (email, ip, card, phone) follow fixed patterns and tests and always
stay.  Further kinds (secret, ssn, iban, dial: a number with an area code in brackets, number:
a long digit run that fails the card test) are candidates that the method may add.

Labelers.  Five of them look at a candidate and vote for, against or abstain: its shape
(regex), words of a gazetteer before it, the characters around it (context), how varied its
characters are, and how usual its length is.

Aggregation.  Candidates are counted by kind and votes, at most a fixed number of rows.  From
these counts expectation-maximisation estimates each labeler's reliabilities and each kind's
share of true spans; the posteriors then train the final span classifier, a logistic
regression on kind and votes, whose weights go back into the DataFrame expression.

Places are counted in code points: matches and the gaps between them come from the same
pattern, and a fold over both adds their lengths up.  Folds that make arrays append to short
blocks, and texts are cut in pieces of PIECE code points, so time and memory for a text of many
matches grow about in proportion to them.

Defined results: a null or empty text has no spans; without candidates the classifier adds
nothing; overlapping spans of different base kinds all stay, added spans never overlap base
ones; equal rows get equal results but for the corpus counts that both belong to; other
columns are not read, and `redact` keeps them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import folded, let, release_driver, table

#: Patterns of the base kinds.  Guards and possessive quantifiers keep them
#: linear on long runs; they find the same matches as the plain patterns.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
EXTRA = {
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "dial": r"(?<![0-9)+])\([0-9]{2,5}\)\x20?[0-9]{3,4}[\x20-][0-9]{3,5}(?![0-9])",
    "number": r"(?<![0-9])[0-9]{13,19}+(?![0-9])",
}
KINDS = [*BASE, *EXTRA]
LEFT, RIGHT = 24, 4
VOTES = ("shape", "gazetteer", "context", "variety", "length")
#: Words that speak for and against personal data in the characters before a candidate.
FOR = r"(?i)(mail|contact|phone|tel|call|mobile|fax|card|visa|iban|account|ssn|social|ip|host|addr|token|password|passwd|pwd|secret|key|login|user|bearer)[^\p{L}]{0,8}$"
AGAINST = r"(?i)(version|license|licen[cs]ed|isbn|issn|page|fig|figure|table|section|chapter|build|release|commit|sha|checksum|hash)[^\p{L}]{0,4}$"
ONE = "struct<s:int,e:int,v:string,left:string,right:string,kind:string>"
CANDIDATE = "struct<s:int,k:int,e:int,v:string,left:string,right:string,kind:string>"
#: Code points of a piece of a text that is cut by places.
PIECE_BITS = 12
PIECE = 1 << PIECE_BITS
SPAN = "array<struct<s:int,k:int,e:int,kind:string>>"


def located(items: Column) -> Column:
    """Array of (s, e, v, left, right, kind) from the matches of all kinds in a row, each with the
    gaps before and after it and whether it is its kind's first."""
    def step(at: Column, x: Column) -> tuple[Column, Column]:
        s = F.when(x["first"], F.lit(0)).otherwise(at) + F.length(x["gap"])
        e = s + F.length(x["v"])
        return e, F.array(F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v"), F.right(x["gap"], F.lit(LEFT)).alias("left"), F.left(x["after"], F.lit(RIGHT)).alias("right"), x["kind"].alias("kind")))

    return folded(items, 0, step, ONE)


def clear_of(more: Column, base: Column) -> Column:
    """The candidates of more that overlap none of base: one pass over both from the left keeps
    those that begin after all earlier ends of base, one from the right those that end before
    all later starts."""
    place = lambda k: lambda x: F.struct(x["s"], F.lit(k).alias("k"), x["e"], x["v"], x["left"], x["right"], x["kind"])
    both = F.sort_array(F.concat(F.transform(base, place(0)), F.transform(more, place(1))))
    none = F.array().cast(f"array<{CANDIDATE}>")
    ahead = lambda at, x: (F.when(x["k"] == 0, F.greatest(at, x["e"])).otherwise(at), F.when((x["k"] == 0) | (at <= x["s"]), F.array(x)).otherwise(none))
    back = lambda at, x: (F.when(x["k"] == 0, F.least(at, x["s"])).otherwise(at), F.when((x["k"] == 1) & (at >= x["e"]), F.array(x)).otherwise(none))
    left = folded(both, 0, ahead, CANDIDATE)
    free = F.reverse(folded(F.reverse(left), (1 << 31) - 1, back, CANDIDATE))
    plain = lambda x: F.struct(x["s"], x["e"], x["v"], x["left"], x["right"], x["kind"])
    return F.when(F.size(more) == 0, more).when(F.size(base) == 0, more).otherwise(F.transform(free, plain))


def luhn(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    def add(a: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.when(F.length(digits).between(14, 19), F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def n_digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TESTS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
    "card": luhn,
    "phone": lambda v: n_digits(v).between(10, 15),
    "number": lambda v: ~luhn(v),
}


def matches(kind: str, found: Column, gaps: Column) -> Column:
    """Array of (v, gap, after, first, kind) of one kind."""
    zipped = F.arrays_zip(found.alias("v"), gaps.alias("gap"), F.slice(gaps, F.lit(2), F.size(gaps) + 1).alias("after"))
    return F.transform(F.filter(zipped, lambda x: x["v"].isNotNull()), lambda x, i: F.struct(x["v"], x["gap"], x["after"], (i == 0).alias("first"), F.lit(kind).alias("kind")))


def passes(x: Column) -> Column:
    """Whether a match passes the test of its kind."""
    out = F.lit(True)
    for kind, test in TESTS.items():
        out = F.when(x["kind"] == kind, test(x["v"])).otherwise(out)
    return out


def with_candidates(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with _base and _extra: arrays of (s, e, v, left, right, kind) structs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digit = text.rlike("[0-9]")
    may = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    parts = docs
    none = F.array().cast("array<string>")
    for kind, pattern in {**BASE, **EXTRA}.items():
        gate = may.get(kind, digit)
        parts = parts.withColumn(f"_v_{kind}", F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    for kind, pattern in {**BASE, **EXTRA}.items():
        parts = parts.withColumn(f"_g_{kind}", F.when(F.size(f"_v_{kind}") > 0, F.split(text, pattern, -1)).otherwise(none))
    every = F.concat(*(matches(k, F.col(f"_v_{k}"), F.col(f"_g_{k}")) for k in KINDS))
    parts = parts.withColumn("_found", F.filter(located(every), passes))
    is_base = lambda x: x["kind"].isin(*BASE)
    parts = parts.withColumn("_base", F.filter("_found", is_base)).withColumn("_more", F.filter("_found", lambda x: ~is_base(x)))
    return parts.withColumn("_extra", clear_of(F.col("_more"), F.col("_base"))).select(*docs.columns, "_base", "_extra")


def votes(x: Column) -> dict[str, Column]:
    """The labelers' votes on a candidate: 1 for, -1 against, 0 abstained."""
    v, kind, vote = x["v"], x["kind"], lambda yes, no: F.when(no, F.lit(-1)).when(yes, F.lit(1)).otherwise(F.lit(0))
    distinct = F.size(F.array_distinct(F.split(F.lower(v), "")))
    usual = {"email": (8, 64), "ip": (7, 15), "card": (15, 19), "phone": (11, 18), "secret": (18, 64), "ssn": (11, 11), "iban": (18, 42), "dial": (12, 18), "number": (99, 100)}
    low, high = (F.coalesce(F.element_at(F.create_map(*(F.lit(y) for k, r in usual.items() for y in (k, r[i]))), kind), F.lit(0)) for i in (0, 1))
    return {
        "shape": F.when(kind == "email", vote(v.rlike(r"\.[A-Za-z]{2,12}$"), v.rlike(r"\.[0-9]+$")))
        .when(kind == "ip", vote(~v.rlike(r"(^|\.)0[0-9]"), v.rlike(r"^0\.")))
        .when(kind == "secret", vote(v.rlike(r"^(?:[0-9a-fA-F]{16,}|(?=.*[0-9].*[0-9].*[0-9])[A-Za-z0-9_-]{24,})$"), v.rlike(r"^[a-z]+(?:-[a-z0-9]+){2,}$")))
        .when(kind == "number", F.lit(-1))
        .otherwise(F.lit(1)),
        "gazetteer": vote(x["left"].rlike(FOR), x["left"].rlike(AGAINST)),
        "context": vote(x["left"].rlike(r"(?:^|[\s=:;,\"'(<\[|])$") & x["right"].rlike(r"^(?:$|[^\p{L}0-9])"), x["left"].rlike(r"[\p{L}0-9]$") | x["right"].rlike(r"^[\p{L}0-9]")),
        "variety": vote(distinct >= 6, distinct <= 3),
        "length": vote(F.length(v).between(low, high), F.length(v) > 2 * high),
    }


def counted_votes(docs: DataFrame, text_col: str = "text") -> list[tuple[str, tuple[int, ...], int]]:
    """(kind, votes, candidates) of the whole corpus: at most kinds x 3^labelers rows."""
    cands = with_candidates(docs.select(text_col), text_col).select(F.explode(F.concat("_base", "_extra")).alias("x"))
    voted = cands.select(F.col("x.kind").alias("kind"), *(c.alias(n) for n, c in votes(F.col("x")).items()))
    rows = voted.groupBy("kind", *VOTES).count().collect()
    return sorted((r["kind"], tuple(r[n] for n in VOTES), r["count"]) for r in rows)


class SpanModel:
    """Reliabilities by expectation-maximisation and the classifier trained on the posteriors."""

    def __init__(self, counted: list[tuple[str, tuple[int, ...], int]], rounds: int = 60):
        self.kind = np.zeros(len(KINDS))
        self.weight = np.zeros((len(VOTES), 2))  # for a vote for, for a vote against
        self.bias = -1.0
        self.reliability = np.full((len(VOTES), 2, 3), 1 / 3)
        if not counted:
            return
        k = np.array([KINDS.index(x) for x, _, _ in counted])
        v = np.array([x for _, x, _ in counted]) + 1
        n = np.array([x for _, _, x in counted], float)
        p = np.clip(0.5 + 0.2 * (v - 1).sum(axis=1), 0.05, 0.95)  # the majority, to begin with
        for _ in range(rounds):
            share = np.array([(np.sum(n * p * (k == j)) + 1) / (np.sum(n * (k == j)) + 2) for j in range(len(KINDS))])
            for i in range(len(VOTES)):
                for z, w in ((0, n * (1 - p)), (1, n * p)):
                    c = np.array([np.sum(w * (v[:, i] == x)) for x in range(3)]) + 1
                    self.reliability[i, z] = c / c.sum()
            log = np.log(np.stack((1 - share[k], share[k]))) + sum(np.log(self.reliability[i][:, v[:, i]]) for i in range(len(VOTES)))
            p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        x = np.column_stack([np.eye(len(KINDS))[k], *((v[:, i] == j).astype(float) for i in range(len(VOTES)) for j in (2, 0)), np.ones(len(n))])
        w, n = np.zeros(x.shape[1]), n / n.sum() * len(n)
        for _ in range(80):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(len(w)), x.T @ (n * (q - p)) + 0.05 * w)
        self.kind, self.weight, self.bias = w[: len(KINDS)], w[len(KINDS) : -1].reshape(-1, 2), w[-1]

    def accepts(self, x: Column) -> Column:
        """Whether the classifier takes a candidate for personal data."""
        z = F.lit(float(self.bias)) + F.element_at(F.create_map(*(F.lit(y) for k, w in zip(KINDS, self.kind, strict=True) for y in (k, float(w)))), x["kind"])
        for (_, vote), (plus, minus) in zip(votes(x).items(), self.weight, strict=True):
            z = z + F.when(vote == 1, F.lit(float(plus))).when(vote == -1, F.lit(float(minus))).otherwise(F.lit(0.0))
        return z >= 0


def with_spans(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """docs with base and spans, arrays of (s, k, e, kind) in order of place, then kind."""
    order = F.create_map(*(F.lit(y) for i, k in enumerate(KINDS) for y in (k, i)))
    plain = lambda x: F.struct(x["s"], F.element_at(order, x["kind"]).alias("k"), x["e"], x["kind"])
    found = with_candidates(docs, text_col)
    chosen = found.withColumn("_chosen", F.filter("_extra", model.accepts))
    return chosen.withColumn("base", F.sort_array(F.transform("_base", plain)).cast(SPAN)).withColumn("spans", F.sort_array(F.transform(F.concat("_base", "_chosen"), plain)).cast(SPAN)).drop("_base", "_extra", "_chosen")


def between(pieces: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text that lies in pieces."""
    def part(c: Column) -> Column:
        low = F.greatest(start - c * PIECE, F.lit(0))
        return F.substring(F.get(pieces, c), low + 1, F.least(end - c * PIECE, F.lit(PIECE)) - low)

    return F.when(end > start, F.array_join(F.transform(F.sequence(F.shiftright(start, PIECE_BITS), F.shiftright(end - 1, PIECE_BITS)), part), "")).otherwise(F.lit(""))


def redacted(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in angle brackets; of spans that overlap, the first."""
    first = lambda at, x: (F.greatest(at, F.when(x["s"] >= at, x["e"])), F.when(x["s"] >= at, F.array(F.struct(x["s"], x["e"], x["kind"]))).otherwise(F.array().cast("array<struct<s:int,e:int,kind:string>>")))
    taken = folded(spans, 0, first, "struct<s:int,e:int,kind:string>")

    def joined(pieces: Column, kept: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(kept, i - 1)["e"]).otherwise(F.lit(0))
        parts = F.transform(kept, lambda x, i: F.concat(between(pieces, before(i), x["s"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        rest = let(F.element_at(kept, -1)["e"], lambda e: between(pieces, e, F.length(text)))
        return F.concat(F.array_join(parts, ""), rest)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, let(pieces, lambda p: let(taken, lambda k: joined(p, k)))).otherwise(text)


def fit_pii(docs: DataFrame, text_col: str = "text") -> SpanModel:
    model = SpanModel(counted_votes(docs, text_col))
    release_driver(docs.sparkSession)  # the same large plan is made once more
    return model


def redact(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """docs with the spans in text_col replaced; all columns stay."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"))
    clean = redacted(F.col("_text"), F.col("spans"))
    return with_spans(packed, model, "_text").select(*(clean.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_spans(docs, fit_pii(docs))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
