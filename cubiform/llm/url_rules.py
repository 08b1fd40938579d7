"""URL filters by association rules.

FP-growth mines the combinations of URL tokens that go with a bad label. Rules survive that have
enough support and confidence and add confidence over every shorter combination inside them; an
inverted index on each rule's rarest token matches them against URLs. Written rules (host and path
prefix) come first; the mined ones decide where none of those fits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Shared, arrow_map, cut, output_schema, prepare, ref, unused

#: Written rules, host then path.
WRITTEN = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BAD = "label=bad"


@dataclass(frozen=True)
class UrlRules:
    """min_support is a share of the labelled URLs, min_count a number of them at least.

    Up to broadcast_rules mined rules travel to the tasks as one index; more are joined to the URLs.
    """

    min_support: float = 0.002
    min_confidence: float = 0.6
    min_gain: float = 0.02
    min_count: int = 5
    broadcast_rules: int = 20_000
    written: tuple[tuple[str, str], ...] = WRITTEN


def split_url(url: str | None) -> tuple[str, str, str]:
    """(host, path, rest): host lower-cased in A-Z; all empty without ://."""
    if url is None or "://" not in url:
        return "", "", ""
    after = url.split("://", 1)[1]
    cut = re.search("[/?#]", after)
    host, left = (after[: cut.start()], after[cut.start() :]) if cut else (after, "")
    path = re.match("[^?#]*", left)[0]
    return host.translate(_LOWER), path, left[len(path) :]


def url_tokens(host: str, path: str, rest: str) -> list[str]:
    """Distinct tokens: host suffixes and labels, path segments and their depth, words of the query.

    A name has 127 labels at most; a longer host has the suffixes of its last 127, and all its labels.
    """
    labels = [x for x in host.split(".") if x]
    found = [f"host:{'.'.join(labels[i:])}" for i in range(max(0, len(labels) - 127), len(labels))]
    for x in labels[:-2]:
        found += [f"label:{x}", *(f"piece:{p}" for p in x.split("-") if p and p != x)]
    segments = [s for s in path.translate(_LOWER).split("/") if s]
    found += [f"path:{'#' if s.isdigit() else s}" for s in segments] + [f"depth:{len(segments)}"]
    found += [f"query:{k}" for k in re.findall(r"[?&#]([^=&#?]+)", rest.translate(_LOWER))]
    return list(dict.fromkeys(found))


def written_rule(host: str, path: str, rules: tuple[tuple[str, str], ...]) -> tuple[str, str] | None:
    """(verdict, rule) of the longest written rule that fits the host, or a host above it, and the path."""
    best = None
    for verdict, rule in rules:
        at, _, under = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + under) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


class Index:
    """Rules by their rarest token."""

    def __init__(self, mined: list[tuple[tuple[str, ...], float]]):
        often = Counter(t for tokens, _ in mined for t in tokens)
        self.by_token: dict[str, list[tuple[frozenset, float, str]]] = {}
        for tokens, confidence in mined:
            key = min(tokens, key=lambda t: (often[t], t))
            self.by_token.setdefault(key, []).append((frozenset(tokens), confidence, " & ".join(sorted(tokens))))

    def match(self, tokens: list[str]) -> tuple[float, str] | None:
        """The most confident rule whose tokens are all there; ties go to the lesser name."""
        have, best = set(tokens), None
        for t in tokens:
            for needs, confidence, name in self.by_token.get(t, ()):
                if needs <= have and (best is None or (-confidence, name) < (-best[0], best[1])):
                    best = (confidence, name)
        return best


RULES = "tokens array<string>, confidence double"


def _tokenised(rows: DataFrame, url: str, keep: list[str]) -> DataFrame:
    """The columns in keep, and the tokens of each URL."""
    schema = output_schema(rows, keep, "tokens array<string>")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [url_tokens(*split_url(u)) for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.list_(pa.string()))], [*keep, "tokens"])

    return arrow_map(rows.select(url, *keep), read, schema)


def _baskets(listed: DataFrame, least: float) -> DataFrame:
    """(row, bad, items): a basket for each labelled URL, from (row, bad, t), a row a token.

    Tokens that stand in the very same URLs are one item, named by the least of them, so that what
    always comes together does not multiply combinations.
    """
    often = listed.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("where")).filter(F.col("n") >= least)
    named = often.groupBy("n", "where").agg(F.min("t").alias("t")).select("t")
    return listed.join(named.hint("merge"), "t").groupBy("row", "bad").agg(F.collect_set("t").alias("items"))


def mine(pages: DataFrame, labels: DataFrame, bad: Column, url: str = "url", page_id: str = "page_id", label_id: str = "doc_id", rules: UrlRules = UrlRules()) -> DataFrame:
    """Rules (tokens, confidence) from labelled pages.

    Labels go to pages by id; null URLs, ids or labels teach nothing. Support and confidence are
    counted on whole URLs, all of them. No labelled page, or none with a bad label, gives no rule.
    """
    spark = prepare(pages.sparkSession)
    known = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("_url")).dropna()
    known = known.join(labels.select(F.col(label_id).alias("_id"), bad.cast("boolean").alias("bad")).dropna(), "_id")
    tokens = cut(_tokenised(known, "_url", ["bad"]), "labelled").withColumn("row", F.monotonically_increasing_id())
    total, wrong = tokens.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    least = max(rules.min_count, rules.min_support * total)
    if not total or wrong < least:
        return spark.createDataFrame([], RULES)
    baskets = cut(_baskets(tokens.select("row", "bad", F.explode("tokens").alias("t")), least), "baskets")
    items = baskets.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(_BAD)))).otherwise(F.col("items")).alias("items"))
    # Shares are of all labelled URLs; those without a frequent token are no baskets.
    held = items.count()
    if not held:
        return spark.createDataFrame([], RULES)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / held), minConfidence=rules.min_confidence).fit(items)
    sets = cut(model.freqItemsets, "itemsets")
    with_bad = sets.filter(F.array_contains("items", _BAD) & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", _BAD)).alias("tokens"), F.col("freq").alias("both"))
    alone = sets.filter(~F.array_contains("items", _BAD)).select(F.array_sort("items").alias("tokens"), "freq")
    # Written tables are small as files and large in memory: no side is sent around whole.
    found = with_bad.join(alone.hint("merge"), "tokens").select("tokens", (F.col("both") / F.col("freq")).alias("confidence"))
    return pruned(cut(found, "candidates"), rules.min_confidence, rules.min_gain)


def pruned(found: DataFrame, min_confidence: float, gain: float) -> DataFrame:
    """The confident rules that add gain to every confident combination inside them.

    found has all combinations of enough support, so that of each its parts are there too. What the
    best part reaches is handed on from combinations to those with one token more, size by size.
    """
    size = F.size("tokens")
    sizes = [r[0] for r in found.select(size).distinct().orderBy(size).collect()]  # as many as the longest has tokens
    kept, best = None, None
    for n in sizes:
        level = found.filter(size == n)
        if best is None:
            level = level.withColumn("inner", F.lit(0.0))
        else:
            parts = level.select("tokens", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("part"))
            reached = parts.join(best.hint("merge"), "part", "left").groupBy("tokens").agg(F.coalesce(F.max("reached"), F.lit(0.0)).alias("inner"))
            level = level.join(reached.hint("merge"), "tokens")
        level = cut(level, "level")
        own = F.when(F.col("confidence") >= min_confidence, F.col("confidence")).otherwise(0.0)
        best = level.select(F.col("tokens").alias("part"), F.greatest(own, "inner").alias("reached"))
        good = level.filter((F.col("confidence") >= min_confidence) & ((F.col("inner") == 0) | (F.col("confidence") >= F.col("inner") + gain))).select("tokens", "confidence")
        kept = good if kept is None else kept.unionByName(good)
    return found.limit(0) if kept is None else cut(kept, "rules")


def joined_matches(urls: DataFrame, mined: DataFrame) -> DataFrame:
    """(url, confidence, mined_rule) of the URLs that a mined rule matches, by a join on its rarest token."""
    listed = mined.select("tokens", "confidence", F.explode("tokens").alias("t"))
    often = listed.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    keyed = listed.join(often, "t").groupBy("tokens", "confidence").agg(F.min(F.struct("n", "t")).alias("k")).select(F.col("k.t").alias("t"), F.col("tokens").alias("needs"), "confidence")
    tokens = _tokenised(urls.select("url").filter("url is not null").distinct(), "url", ["url"])
    met = tokens.select("url", "tokens", F.explode("tokens").alias("t")).join(keyed, "t").filter(F.size(F.array_except("needs", "tokens")) == 0)
    name = F.array_join(F.array_sort("needs"), " & ")
    best = met.groupBy("url").agg(F.min(F.struct((-F.col("confidence")).alias("less"), name.alias("name"))).alias("b"))
    return best.select("url", (-F.col("b.less")).alias("confidence"), F.col("b.name").alias("mined_rule"))


def judge_urls(pages: DataFrame, mined: DataFrame | list[tuple[tuple[str, ...], float]], url: str = "url", keep: list[str] | None = None, rules: UrlRules = UrlRules()) -> DataFrame:
    """The columns in keep (all when None) with host, path, rule, verdict, mined_rule and confidence.

    mined: rules as mine gives them, or a list of (tokens, confidence). A null URL, or one without
    ://, has an empty host and path, fits no rule and is allowed. Very long URLs are read whole;
    repeated rows are judged one by one; of a clashing input column the output wins; an empty table
    gives an empty one.
    """
    spark = prepare(pages.sparkSession)
    made = ["host", "path", "rule", "verdict", "mined_rule", "confidence"]
    keep = [c for c in (pages.columns if keep is None else keep) if c not in made]
    schema = output_schema(pages, keep, "host string, path string, rule string, verdict string, mined_rule string, confidence double")
    mined = mined if isinstance(mined, DataFrame) else spark.createDataFrame([(list(t), c) for t, c in mined], RULES)
    few = mined.select("tokens", "confidence").limit(rules.broadcast_rules + 1).collect()
    if len(few) > rules.broadcast_rules:
        return _judged_by_join(pages, mined, url, keep, rules).select(*(ref(c) for c in [*keep, *made]))
    shared = Shared(spark, Index([(tuple(r.tokens), r.confidence) for r in few]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.load()
        for batch in batches:
            rows = []
            for u in batch.column(batch.schema.get_field_index(url)).to_pylist():
                host, path, rest = split_url(u)
                fixed = written_rule(host, path, rules.written)
                found = index.match(url_tokens(host, path, rest)) if host or path else None
                verdict = fixed[0] if fixed else "block" if found else "allow"
                rows.append((host, path, fixed and fixed[1], verdict, found and found[1], found and found[0]))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            made_columns = [pa.array([r[i] for r in rows], pa.string() if i < 5 else pa.float64()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([*columns, *made_columns], [*keep, *made])

    return arrow_map(pages.select(*(f"`{c}`" for c in dict.fromkeys([*keep, url]))), judge, schema)


def _judged_by_join(pages: DataFrame, mined: DataFrame, url: str, keep: list[str], rules: UrlRules) -> DataFrame:
    """The same judgement where the rules are too many for one task: each different URL meets them in a join."""
    prefix = unused(pages, "_url_")
    matches = joined_matches(pages.select(ref(url).alias("url")), mined).select(F.col("url").alias(f"{prefix}key"), F.col("confidence").alias(f"{prefix}confidence"), F.col("mined_rule").alias(f"{prefix}name"))
    plain = judge_urls(pages.withColumn(f"{prefix}key", ref(url)), [], url, [*keep, f"{prefix}key"], rules)
    both = plain.drop("mined_rule", "confidence").join(matches, f"{prefix}key", "left")
    found = F.when((F.col("host") != "") | (F.col("path") != ""), F.col(f"{prefix}name"))
    both = both.withColumn("mined_rule", found).withColumn("confidence", F.when(found.isNotNull(), F.col(f"{prefix}confidence")))
    return both.withColumn("verdict", F.when(F.col("rule").isNull() & F.col("mined_rule").isNotNull(), "block").otherwise(F.col("verdict")))
