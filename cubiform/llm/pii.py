"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

DataFrame functions only. Positions come from the pieces between matches: a match starts after
all pieces and matches before it, in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import ref, unused

#: The pattern of each kind, in the order in which kinds are listed. Those of the first four find
#: what the plain forms in PLAIN find, but in linear time: a match may only begin where a run of
#: its first class begins, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9_])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = ("email", "ip", "card", "phone")
#: A character without which a kind can't match; texts without it are passed over.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}


@dataclass(frozen=True)
class PiiRules:
    """Scores: a span begins with its kind's score, context words near it add; below the limit it goes.

    Base kinds carry a score at the limit, so they always stay. An IBAN passes mod 97 and stays; a
    number written like a social security number stays only near a context word.
    """

    scores: tuple[tuple[str, float], ...] = (("email", 0.9), ("ip", 0.7), ("card", 0.8), ("phone", 0.6), ("iban", 0.8), ("ssn", 0.3))
    context: tuple[tuple[str, str], ...] = (
        ("email", "e-?mail|contact|write"), ("ip", "ip|server|host|address"), ("card", "card|visa|payment"),
        ("phone", "phone|tel|call|mobile"), ("iban", "iban|bank|account"), ("ssn", "ssn|social|security|tax"),
    )
    context_score: float = 0.3
    context_chars: int = 40
    limit: float = 0.5


def luhn(digits: Column) -> Column:
    """The Luhn check, on a string of digits."""
    each = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """The ISO 7064 check, on letters and digits without spaces."""
    turned = F.split(F.concat(F.substring(iban, 5, 60), F.substring(iban, 1, 4)), "(?<=.)(?=.)")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97) == 1


def confirmed(kind: str, found: Column) -> Column:
    """Whether a match of the kind's pattern is one."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        bare = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(found, r"\."), lambda p: (F.length(bare(p)) < 3) | ((F.length(bare(p)) == 3) & (bare(p) <= "255")))
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        bare = F.replace(found, F.lit(" "), F.lit(""))
        return F.length(bare).between(15, 34) & mod97(bare)
    return F.lit(True)


#: Values of one block of a running total.
BLOCK = 128


def before(values: Column, combine, zero: int = 0) -> Column:
    """At each place of an array of ints, all values in front of it, combined.

    An array that grows by a value is copied each time, so totals run inside blocks first, then over
    the blocks.
    """
    def running(some: Column) -> Column:
        state = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(some, state, lambda a, v: F.struct(combine(a["at"], v).cast("int").alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: running(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))
    whole = F.struct(blocks.alias("blocks"), running(F.transform(blocks, lambda b: b["at"]))["all"].alias("first"))
    long = F.transform(F.array(whole), lambda w: F.flatten(F.transform(w["blocks"], lambda b, i: F.transform(b["all"], lambda v: combine(F.get(w["first"], i), v).cast("int")))))
    return F.when(F.size(values) > BLOCK, F.get(long, F.lit(0))).otherwise(running(values)["all"])


def _filtered(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: confirmed(kind, s["found"]))


def proposals(docs: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds for each kind prefix + kind: an array of (start, stop, found) of all matches, in order."""
    found, pieces = F.col(f"{prefix}found"), F.col(f"{prefix}pieces")
    for kind, pattern in PATTERNS.items():
        body = F.col(text)
        if kind in NEEDS:
            body = F.when(F.contains(body, F.lit(NEEDS[kind])), body).otherwise("")
        elif kind == "card":
            body = F.when(body.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), body).otherwise("")
        elif kind == "iban":
            body = F.when(body.rlike(r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{11}"), body).otherwise("")
        docs = docs.withColumn(f"{prefix}found", F.regexp_extract_all(body, F.lit(pattern), F.lit(0)))
        docs = docs.withColumn(f"{prefix}pieces", F.when(F.size(found) > 0, F.split(body, pattern, -1)).otherwise(F.array().cast("array<string>")))
        none = F.array().cast("array<struct<start:int,stop:int,found:string>>")
        parts = F.arrays_zip(found.alias("f"), F.slice(pieces, F.lit(1), F.size(found)).alias("p"))
        docs = docs.withColumn(f"{prefix}at", F.when(F.size(found) > 0, before(F.transform(parts, lambda x: F.length(x["p"]) + F.length(x["f"])), lambda a, v: a + v)))

        def one(x: Column) -> Column:
            start = x["at"] + F.length(x["p"])
            return F.struct(start.alias("start"), (start + F.length(x["f"])).alias("stop"), x["f"].alias("found"))

        placed = F.arrays_zip(found.alias("f"), F.slice(pieces, F.lit(1), F.size(found)).alias("p"), F.col(f"{prefix}at").alias("at"))
        spans = F.when(F.size(found) > 0, F.transform(placed, one)).otherwise(none)
        docs = docs.withColumn(f"{prefix}{kind}", _filtered(kind, spans)).drop(f"{prefix}found", f"{prefix}pieces", f"{prefix}at")
    return docs


def scored(kind: str, spans: Column, text: Column, rules: PiiRules) -> Column:
    """The kind's spans with scores, those below the limit left out unless the kind is a base one."""
    words, first = f"(?i)(?<![A-Za-z0-9_])(?:{dict(rules.context)[kind]})(?![A-Za-z0-9_])", dict(rules.scores)[kind]

    def one(s: Column) -> Column:
        before = F.greatest(s["start"] - rules.context_chars, F.lit(0))
        near = F.substr(text, before + 1, s["stop"] - before + rules.context_chars)
        score = F.least(F.lit(1.0), F.lit(first) + F.when(near.rlike(words), rules.context_score).otherwise(0.0))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), score.alias("score"))

    found = F.transform(spans, one)
    return found if kind in BASE else F.filter(found, lambda s: s["score"] >= rules.limit)


def find_pii(docs: DataFrame, text: str = "text", rules: PiiRules = PiiRules(), spans: str = "pii_spans") -> DataFrame:
    """Adds spans: an array of (kind, start, stop, score), by kind as listed, then start.

    Places count code points, stop is exclusive. A null or empty text has an empty array; a very long
    text is read whole; repeated rows are treated one by one; an input column named like the output
    gives way to it; an empty table gives an empty one.
    """
    prefix = unused(docs, "_pii_")
    body = docs.withColumn(f"{prefix}text", F.coalesce(ref(text), F.lit("")))
    body = proposals(body, f"{prefix}text", prefix)
    found = F.concat(*(scored(k, F.col(f"{prefix}{k}"), F.col(f"{prefix}text"), rules) for k in PATTERNS))
    return body.withColumn(spans, found).drop(f"{prefix}text", *(f"{prefix}{k}" for k in PATTERNS))


def listed(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(docs: DataFrame, text: str = "text", rules: PiiRules = PiiRules()) -> DataFrame:
    """Replaces each span in text by [KIND]; where spans overlap, the later one starts at the earlier one's stop.

    A null text stays null, and an empty one empty; a very long text is read whole; repeated rows are
    treated one by one; all other columns stay; an empty table gives an empty one.
    """
    prefix = unused(docs, "_pii_")
    spans, at = f"{prefix}spans", f"{prefix}from"
    found = find_pii(docs, text, rules, spans)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    found = found.withColumn(spans, ordered).withColumn(at, before(F.transform(spans, lambda s: s["stop"]), F.greatest))

    def part(x: Column) -> Column:
        clean = F.substr(ref(text), x["from"] + 1, F.greatest(x["s"]["start"] - x["from"], F.lit(0)))
        return F.when(x["s"]["stop"] > x["from"], F.concat(clean, F.lit("["), F.upper(x["s"]["kind"]), F.lit("]"))).otherwise("")

    parts = F.transform(F.arrays_zip(F.col(spans).alias("s"), F.col(at).alias("from")), part)
    last = F.array_max(F.transform(spans, lambda s: s["stop"]))
    clean = F.concat(F.array_join(parts, ""), F.substr(ref(text), last + 1, F.lit(2**31 - 1) - last))
    return found.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(ref(text))).select(*(ref(c) for c in docs.columns))
