"""Benchmark decontamination with a generalised suffix automaton of the test items.

Each worker streams documents' words through the automaton and follows the longest matching
length; where that reaches a window of an item, the window's words are hit. Only stretches whose
consecutive pairs of words all occur in items are streamed, which loses no window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .store import Shared, arrow_map, cut, output_schema, prepare, shielded, unshielded

#: Maps bytes to what words consist of: A-Z lower-cased, all that is no word byte to a space.
_FOLD = bytes(int(tc.LOWER[b]) if tc.ALNUM[b] else 0x20 for b in range(256))


@dataclass(frozen=True)
class LeakRules:
    """window: words of an item that count as a leak; shorter items count whole.

    A span is removed where a match is window words or longer. In filtering, a document goes
    when its hit words exceed max_hit_percent of its words. block_words bounds the items that one
    automaton holds; more items are streamed in further passes over the same rows.
    """

    window: int = 10
    max_hit_percent: int = 50
    block_words: int = 1_000_000


def tokens(text: str | None) -> list[bytes]:
    """The words of a text: runs of letters, digits and all that is outside ASCII, A-Z lower-cased."""
    return (text or "").encode().translate(_FOLD).split()


@dataclass
class Automaton:
    """A generalised suffix automaton over word ids, grown one item at a time."""

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    moves: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: By (state, window length): the items with that window.
    owners: dict[tuple[int, int], set[str | None]] = field(default_factory=dict)
    #: The window lengths that occur in each state.
    lengths: dict[int, tuple[int, ...]] = field(default_factory=dict)
    pairs: set[int] = field(default_factory=set)
    single: set[int] = field(default_factory=set)

    def _extend(self, last: int, c: int) -> int:
        known = self.moves[last].get(c)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, c, known)
        state = self._state(self.length[last] + 1, {})
        while last != -1 and c not in self.moves[last]:
            self.moves[last][c] = state
            last = self.link[last]
        if last == -1:
            self.link[state] = 0
        else:
            follow = self.moves[last][c]
            self.link[state] = follow if self.length[follow] == self.length[last] + 1 else self._split(last, c, follow)
        return state

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.moves.append(moves)
        self.link.append(0)
        self.length.append(length)
        return len(self.moves) - 1

    def _split(self, last: int, c: int, old: int) -> int:
        """A copy of old for its strings of at most length(last) + 1 words."""
        copy = self._state(self.length[last] + 1, dict(self.moves[old]))
        self.link[copy], self.link[old] = self.link[old], copy
        while last != -1 and self.moves[last].get(c) == old:
            self.moves[last][c] = copy
            last = self.link[last]
        return copy

    def add(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))

    def finish(self, items: list[tuple[str, list[bytes]]]) -> Automaton:
        """Notes which windows belong to which items, once all items have been added."""
        for name, words in items:
            ids = [self.vocabulary[w] for w in words]
            n = min(self.window, len(ids))
            for at, state, matched in self.stream(ids):
                if n and at + 1 >= n and matched >= n:
                    self.owners.setdefault((self.at_length(state, n), n), set()).add(name)
            if n == 1:
                self.single.add(ids[0])
        found: dict[int, set[int]] = {}
        for state, n in self.owners:
            found.setdefault(state, set()).add(n)
        self.lengths = {k: tuple(sorted(v)) for k, v in found.items()}
        return self

    def at_length(self, state: int, n: int) -> int:
        """The state that holds the last n words matched."""
        while self.length[self.link[state]] >= n and state:
            state = self.link[state]
        return state

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int, int]]:
        """(place, state, longest matching length) after each word; unknown words are negative."""
        state = matched = 0
        moves, link, length = self.moves, self.link, self.length
        for at, c in enumerate(ids):
            while state and c not in moves[state]:
                state = link[state]
                matched = length[state]
            following = moves[state].get(c)
            state, matched = (following, matched + 1) if following is not None else (0, 0)
            yield at, state, matched

    def hits(self, ids: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(first, end, items) of every window that occurs."""
        for at, state, matched in self.stream(ids):
            while state:
                for n in self.lengths.get(state, ()):
                    if n <= matched:
                        yield at + 1 - n, at + 1, self.owners[state, n]
                state = self.link[state]
                matched = self.length[state]


def build(items: list[tuple[str, str]], rules: LeakRules) -> list[Automaton]:
    """Automata of the items, each of at most block_words words (or one longer item)."""
    blocks: list[list[tuple[str, list[bytes]]]] = []
    size = rules.block_words
    for name, text in items:
        words = tokens(text)
        if not words:
            continue
        if size + len(words) > rules.block_words:
            blocks.append([])
            size = 0
        blocks[-1].append((name, words))
        size += len(words)
    made = []
    for block in blocks:
        one = Automaton(rules.window)
        for _, words in block:
            one.add(words)
            ids = [one.vocabulary[w] for w in words]
            one.pairs.update(a << 32 | b for a, b in zip(ids, ids[1:]))
        made.append(one.finish(block))
    return made


class Matcher:
    """Finds windows in documents, with an array test for the stretches that are worth streaming."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        pairs = np.fromiter(automaton.pairs, np.uint64, len(automaton.pairs))
        self.bits = max(16, int(len(pairs)).bit_length() + 5)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(pairs)] = True

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit ranges in word places, and the items that occur."""
        found = self.automaton
        ids = np.fromiter(map(found.vocabulary.get, words, _ABSENT), np.int64, len(words))
        wide = ids.astype(np.uint64)
        known = ids >= 0
        joined = known[:-1] & known[1:]
        joined[joined] = self.seen[self._slot((wide[:-1] << np.uint64(32) | wide[1:])[joined])]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], joined.view(np.int8), [0]))))
        ranges, items = [], set()
        least = min((n for _, n in found.owners), default=0)
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a + 1 < least:
                continue
            for first, end, owners in found.hits(ids[a : b + 1].tolist()):
                ranges.append((a + first, a + end))
                items |= owners
        if found.single:
            for at in np.flatnonzero(known).tolist():
                if int(ids[at]) in found.single:
                    ranges.append((at, at + 1))
                    for first, end, owners in found.hits([int(ids[at])]):
                        items |= owners
        return ranges, items - {None}


class _Absent:
    """An endless supply of -1, as the default of dict.get."""

    def __iter__(self):
        return self

    def __next__(self) -> int:
        return -1


_ABSENT = _Absent()


def item_blocks(items: DataFrame, item_id: str, text: str, rules: LeakRules) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of bounded size, so that the driver never holds them all.

    The bound counts characters: a word has one at least, and its separator another. Items are dealt
    to blocks by hash, twice as many blocks as would just hold them.
    """
    bound = 2 * rules.block_words
    sized = items.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    total = sized.agg(F.sum(F.length("body"))).first()[0] or 0
    if total <= bound:
        yield [(r.item, r.body) for r in sized.collect()]
        return
    blocks = 2 * -(-total // bound)
    for block in range(blocks):
        yield [(r.item, r.body) for r in sized.filter(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == block).collect()]


SCHEMA = "n_words long, hit_ranges array<struct<first:int,end:int>>, hit_items array<string>"


def find_leaks(docs: DataFrame, items: DataFrame, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", rules: LeakRules = LeakRules(), keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all when None) with n_words, hit_ranges (merged, in words) and hit_items.

    A null or empty text has no words and no hits; a very long text is streamed whole. Items without
    words never occur; those without an id hit words but are not listed; repeated items count once. Of
    a clashing input column, the output wins. Empty tables give empty or unhit results. Items beyond
    one block are streamed block by block, in passes that are written out between, so that a task
    holds one automaton.
    """
    spark = prepare(docs.sparkSession)
    made = ["n_words", "hit_ranges", "hit_items"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    read = list(dict.fromkeys([*keep, doc_text]))
    out = docs.select(*(f"`{c}`" for c in read))
    automata = (one for block in item_blocks(items, item_id, item_text, rules) for one in build(block, rules))
    done = 0
    for automaton in automata:
        out = _pass(cut(out, "leaks") if done else out, Shared(spark, automaton), read, doc_text, not done)
        done += 1
    if not done:
        out = _pass(out, Shared(spark, Automaton(rules.window)), read, doc_text, True)
    return out.select(*(f"`{c}`" for c in [*keep, *made]))


def _pass(docs: DataFrame, shared: Shared, read: list[str], text: str, first: bool) -> DataFrame:
    schema = output_schema(docs, read, SCHEMA)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.load())
        for batch in batches:
            at = batch.schema.get_field_index
            data, offsets = tc.utf8(batch.column(at(text)))
            body = memoryview(data).tobytes().translate(_FOLD)
            counts, ranges, items = [], [], []
            for i in range(batch.num_rows):
                words = body[offsets[i] : offsets[i + 1]].split()
                found, owners = matcher.match(words) if len(words) else ([], set())
                if not first:
                    found += [(r["first"], r["end"]) for r in batch.column(at("hit_ranges"))[i].as_py()]
                    owners |= set(batch.column(at("hit_items"))[i].as_py())
                counts.append(len(words))
                ranges.append([{"first": a, "end": b} for a, b in merged(found)])
                items.append(sorted(owners))
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            columns = [batch.column(at(c)) for c in read]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(ranges, kind), pa.array(items, pa.list_(pa.string()))], [*read, "n_words", "hit_ranges", "hit_items"])

    return arrow_map(docs, judge, schema)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges' union, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(ranges)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def decontaminate(docs: DataFrame, items: DataFrame, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", rules: LeakRules = LeakRules()) -> DataFrame:
    """Drops documents whose hit words exceed the limit, and cuts the hit spans out of the others.

    The columns of docs, in order. A cut takes the span's words with all between them; texts without
    a hit stay as they are, null ones too.
    """
    own, back = shielded(docs, ["n_words", "hit_ranges", "hit_items"])
    found = find_leaks(own, items, doc_text, item_id, item_text, rules)
    found = found.filter(F.expr(f"100 * aggregate(hit_ranges, 0L, (a, r) -> a + r.end - r.first) <= {rules.max_hit_percent} * n_words"))
    names = own.columns

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            texts, spans = batch.column(at(doc_text)).to_pylist(), batch.column(at("hit_ranges"))
            for i in range(batch.num_rows):
                if spans[i].values is None or not len(spans[i].values):
                    continue
                body = texts[i].encode()
                buffer = np.frombuffer(body, np.uint8)
                starts, ends, _ = tc.words(buffer, np.array([0, len(body)]), tc.ALNUM)
                left, done = [], 0
                for r in spans[i].as_py():
                    left.append(body[done : starts[r["first"]]])
                    done = ends[r["end"] - 1]
                texts[i] = b"".join([*left, body[done:]]).decode()
            columns = [pa.array(texts, batch.column(at(c)).type) if c == doc_text else batch.column(at(c)) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return unshielded(arrow_map(found, trim, own.schema), docs.columns, back)
