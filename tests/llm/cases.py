"""Tables that no operator may fall over, and plain versions of what the operators compute."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long"
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = ("word %d and a tail of more text, " * 400) % tuple(range(400))


def hard_rows():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows."""
    base = "The quick brown fox jumps over the lazy dog while the band plays a slow tune about rivers and towns far away from home. "
    rows = [
        (1, None, "en", "a", 1), (2, "", "en", "a", 0), (3, " \t\n ", None, "a", 4), (4, base * 3, "en", None, None), (5, base * 3, "en", "b", 1), (5, base * 3, "en", "b", 1),
        (None, base * 3, "en", "b", 1), (None, None, None, None, None), (6, "short", "en", "b", 5), (7, "short", "en", "c", 5), (8, LONG, "en", "a", len(LONG)), (9, LONG + " end", "en", "a", 1),
        (10, "x" * 100_000, "en", "a", 1), (11, "1" * 100_000, "de", "a", 1), (12, "a@b." * 5_000, "de", "a", 1), (13, "é ü ß " * 500, "de", "a", 1), (14, "\0\u2028 x\n\n\ny" * 10, "fr", "b", 1), (15, "1 2 3 " * 5_000, "de", "a", 1),
    ]
    return rows


def hard(spark, clash=()):
    df = spark.createDataFrame(hard_rows(), DDL)
    for name in clash:
        df = df.withColumn(name, F.lit("own"))
    return df


def empty(spark):
    return spark.createDataFrame([], DDL)


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_FOLD))


def shingles(text):
    words = blank_words((text or "").translate(_FOLD))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_components(docs):
    """From {id: text}: {id: least id reachable}."""
    sets = {i: shingles(t) for i, t in docs.items()}
    having, parent = defaultdict(list), {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in sorted(sets):
        met = Counter(j for s in sets[i] for j in having[s])
        for j, n in met.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for s in sets[i]:
            having[s].append(i)
    return {i: find(i) for i in docs}


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(spark, sf=SF):
    return {r.doc_id: r.text for r in documents(spark, sf).collect()}
