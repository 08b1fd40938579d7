"""Secret scans with multipart credential linking.

Plain patterns find assignments, access identifiers and long hex strings. Beyond those, weak
candidates (client identifiers, opaque tokens, endpoints) are reported only where complementary
parts stand together: an interval join, inside a scope, of identifiers with secrets and endpoints.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .store import arrow_map, output_schema, prepare

#: Base kinds in the order listed. Letters of the assignment's name match in either case.
BASE = {
    "assign": re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
}
#: Parts that mean something only together, and the role of each. Runs are taken whole, however long.
WEAK = {
    "client": ("identifier", re.compile(r"\b(?ai:client_?id|account_?id|user(?:name)?|login)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9@._-]{3,})")),
    "opaque": ("secret", re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{32,}+={0,2}+(?![A-Za-z0-9+/=_-])")),
    "endpoint": ("endpoint", re.compile(r"\b(?:https?|s3|postgres|mysql|redis|amqp|mongodb)://[A-Za-z0-9._-]{3,}+(?::[0-9]+)?")),
}
#: What a weak part must hold besides its pattern.
HOLDS = {"opaque": (re.compile("[0-9]"), re.compile("[A-Z]"))}
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret"}
_key_hint = re.compile("[:=]")


@dataclass(frozen=True)
class LinkRules:
    """Parts link when they lie in one scope, with at most reach code points between them.

    A scope ends at a blank line. A weak secret needs an identifier, and a weak identifier a secret;
    an endpoint needs both.
    """

    reach: int = 200
    min_assigned: int = 6
    min_access: int = 20


SCHEMA = "kind string, start int, stop int, linked boolean"


def base_spans(text: str, rules: LinkRules = LinkRules()) -> list[tuple[int, str, int]]:
    """(start, kind, stop) of the plain kinds, by start, then kind as listed."""
    found = []
    if _key_hint.search(text):
        found += [(m.start(), "assign", m.end()) for m in BASE["assign"].finditer(text) if m.end(2) - m.start(2) >= rules.min_assigned]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in BASE["access"].finditer(text) if m.end() - m.start() >= rules.min_access]
    found += [(m.start(), "hex", m.end()) for m in BASE["hex"].finditer(text)]
    rank = {k: i for i, k in enumerate(BASE)}
    return sorted(found, key=lambda s: (s[0], rank[s[1]]))


def _near(places: list[tuple[int, int]], start: int, stop: int, reach: int, widest: int) -> bool:
    """Whether any of the sorted intervals, none longer than widest, lies within reach and isn't the same one."""
    i = bisect_left(places, (start - reach - widest, 0))
    while i < len(places) and places[i][0] <= stop + reach:
        if places[i][1] >= start - reach and not (places[i][0] < stop and start < places[i][1]):
            return True
        i += 1
    return False


def linked_spans(text: str, base: list[tuple[int, str, int]], rules: LinkRules = LinkRules()) -> list[tuple[int, str, int]]:
    """Weak parts that co-occur with their complements: (start, kind, stop), by start."""
    weak = [(m.start(), kind, m.end()) for kind, (_, pattern) in WEAK.items() for m in pattern.finditer(text) if all(h.search(m[0]) for h in HOLDS.get(kind, ()))]
    weak = [w for w in weak if not any(b[0] < w[2] and w[0] < b[2] for b in base)] if len(base) < 8 else _apart(weak, base)
    if not weak:
        return []
    ends = [m.end() for m in re.finditer(r"\n[\x20\t]*\n", text)]
    scopes: dict[int, dict[str, list]] = {}
    for start, kind, stop in [*base, *weak]:
        role = ROLES.get(kind) or WEAK[kind][0]
        scopes.setdefault(bisect_left(ends, start + 1), {}).setdefault(role, []).append((start, stop))
    for parts in scopes.values():
        for places in parts.values():
            places.sort()
    kept = []
    for start, kind, stop in weak:
        parts = scopes[bisect_left(ends, start + 1)]
        role = WEAK[kind][0]
        needs = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("identifier", "secret")}[role]
        if all(parts.get(n) and _near(parts[n], start, stop, rules.reach, max(b - a for a, b in parts[n])) for n in needs):
            kept.append((start, kind, stop))
    return sorted(kept)


def _apart(weak: list, base: list) -> list:
    """The weak spans that overlap no base span."""
    spans = sorted((b[0], b[2]) for b in base)
    starts, reach, high = [s for s, _ in spans], [], 0
    for _, stop in spans:
        high = max(high, stop)
        reach.append(high)
    kept = []
    for w in weak:
        i = bisect_left(starts, w[2])
        if i == 0 or reach[i - 1] <= w[0]:
            kept.append(w)
    return kept


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rules: LinkRules = LinkRules(), spans: str = "secret_spans") -> DataFrame:
    """The columns in keep (all when None) with spans: an array of (kind, start, stop, linked).

    Ordered by start, then kind; places count code points, stop is exclusive; linked marks the spans
    that the linking adds. A null text counts as empty and has no spans; a very long text is scanned
    whole, its parts joined by place; repeated rows are scanned one by one; an input column named like
    the output gives way to it; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != spans]
    schema = output_schema(docs, keep, f"`{spans}` array<struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>>")
    made = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("linked", pa.bool_())]))
    order = {k: i for i, k in enumerate([*BASE, *WEAK])}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(batch.schema.get_field_index(text)):
                body = value.as_py() or ""
                base = base_spans(body, rules)
                found = [(s, k, e, False) for s, k, e in base] + [(s, k, e, True) for s, k, e in linked_spans(body, base, rules)]
                found.sort(key=lambda s: (s[0], order[s[1]]))
                rows.append([{"kind": k, "start": s, "stop": e, "linked": linked} for s, k, e, linked in found])
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, made)], [*keep, spans])

    read = list(dict.fromkeys([*keep, text]))
    return arrow_map(docs.select(*(f"`{c}`" for c in read)), judge, schema)
