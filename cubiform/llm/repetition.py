"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, in numpy, find the n-grams that a text repeats; the
characters inside repeated n-grams and repeated lines, as shares of the text, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textcore as tc
from .store import arrow_map, output_schema, prepare, shielded, unshielded

WINDOW = 5
SYMBOLS = tc._class(*((ord(c), ord(c)) for c in "#*$%&|<>"))


@dataclass(frozen=True)
class QualityRules:
    """Limits. Coverage shares are of the characters in words; a text at a limit is kept."""

    min_words: int = 10
    max_repeat_word_percent: int = 20
    #: n-gram length and the largest percentage of characters inside n-grams that occur again.
    coverage: tuple[tuple[int, int], ...] = ((5, 30), (8, 25), (10, 20))
    max_dup_line_percent: int = 30
    #: Symbols for each hundred words.
    max_symbols_percent: int = 50


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, "
    "dup_ngram_chars array<long>, base_failed boolean, kept boolean"
)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    found = np.zeros(len(keys), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found


def again(keys: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    found = np.zeros(len(keys), bool)
    found[order[1:]] = keys[order][1:] == keys[order][:-1]
    return found


def measure(column: pa.Array, rules: QualityRules) -> dict[str, np.ndarray]:
    """The columns of SCHEMA for a string column; a null text has no words."""
    data, offsets = tc.utf8(column)
    n = len(offsets) - 1
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")}
    lengths = [k for k, _ in rules.coverage]
    dup = np.zeros((n, len(lengths)), np.int64)
    for first, end, part, at in tc.slices(data, offsets):
        starts, ends, word_at = tc.words(part, at, tc.SPACED)
        points = np.concatenate(([0], np.cumsum(tc.code_points(part))))
        chars = points[ends] - points[starts]
        running = np.concatenate(([0], np.cumsum(chars)))
        rows = slice(first, end)
        out["n_words"][rows] = np.diff(word_at)
        out["word_chars"][rows] = np.diff(running[word_at])
        symbols = np.concatenate(([0], np.cumsum(SYMBOLS[part])))
        out["n_symbols"][rows] = np.diff(symbols[at])
        # Lines: the cuts after each \n and at documents' ends; a \n at a text's end opens an empty line.
        breaks = np.flatnonzero(part == 10)
        line_starts = np.unique(np.concatenate((at[:-1], breaks + 1)))
        line_starts = line_starts[line_starts < len(part)]
        line_ends = np.append(line_starts[1:], len(part))
        line_ends = line_ends - ((line_ends > line_starts) & (part[line_ends - 1] == 10))
        filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        line_starts, line_ends = line_starts[filled], line_ends[filled]
        line_keys = tc.hashes(part, line_starts, line_ends)
        line_at = np.searchsorted(line_starts, at)
        line_words = running[np.searchsorted(starts, line_ends)] - running[np.searchsorted(starts, line_starts)]
        keys = tc.hashes(part, starts, ends)
        grams = {k: tc.ngrams(keys, k) for k in {WINDOW, *lengths}}
        for i in range(end - first):
            lo, hi = line_at[i], line_at[i + 1]
            if hi - lo > 1:
                later = again(line_keys[lo:hi])
                out["n_dup_lines"][first + i] = later.sum()
                out["dup_line_chars"][first + i] = line_words[lo:hi][later].sum()
            lo, hi = word_at[i], word_at[i + 1]
            for k, found in grams.items():
                if hi - lo <= k:
                    continue
                twice = np.flatnonzero(repeated(found[lo : hi - k + 1]))
                if not len(twice):
                    continue
                inside = tc.covered(twice, twice + k, hi - lo)
                if k == WINDOW:
                    out["n_repeat_words"][first + i] = inside.sum()
                if k in lengths:
                    dup[first + i, lengths.index(k)] = chars[lo:hi][inside].sum()
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_word_percent * out["n_words"])
    kept = ~out["base_failed"]
    for j, (_, most) in enumerate(rules.coverage):
        kept &= 100 * dup[:, j] <= most * out["word_chars"]
    kept &= 100 * out["dup_line_chars"] <= rules.max_dup_line_percent * out["word_chars"]
    kept &= 100 * out["n_symbols"] <= rules.max_symbols_percent * out["n_words"]
    return out | {"dup_ngram_chars": dup, "kept": kept}


def quality(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rules: QualityRules = QualityRules()) -> DataFrame:
    """Judge every text; returns the columns in keep (all but those of SCHEMA when None) with SCHEMA's.

    A null or empty text has no words and fails. Repeated rows are judged one by one. Of an input
    column that has the name of an output column, the output wins. An empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    made = [x.split()[0] for x in SCHEMA.split(", ")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    schema = output_schema(docs, keep, SCHEMA)
    read = list(dict.fromkeys([*keep, text]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column(batch.schema.get_field_index(text)), rules)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            for c in made:
                if c == "dup_ngram_chars":
                    at = np.arange(0, found[c].size + 1, len(rules.coverage), dtype=np.int32) if rules.coverage else np.zeros(batch.num_rows + 1, np.int32)
                    columns.append(pa.ListArray.from_arrays(at, found[c].ravel()))
                else:
                    columns.append(pa.array(found[c]))
            yield pa.RecordBatch.from_arrays(columns, [*keep, *made])

    return arrow_map(docs.select(*(f"`{c}`" for c in read)), judge, schema)


def keep_good(docs: DataFrame, text: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """docs without the rows that the rules reject; all columns as they were.

    A null, empty or blank text has too few words and goes; very long texts are measured whole;
    repeated rows are judged one by one; an empty table gives an empty one.
    """
    own, back = shielded(docs, [x.split()[0] for x in SCHEMA.split(", ")])
    return unshielded(quality(own, text, rules=rules).filter("kept"), docs.columns, back)
