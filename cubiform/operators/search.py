"""Population search for smaller programs: islands, elites, tournaments, migration, checkpoints.

An epoch is one Spark job: each island breeds its generations in a task of its own and knows what it
has seen; between epochs the best of all islands migrates, and the population is a table. Every draw
comes from a generator seeded by (seed, island, generation), so neither the number of partitions nor
a restart changes a result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import cubiform

from ..sources import programs as P
from ..sources.wire import FormatError
from .random import ChaCha8
from .variation import MUTATIONS, Building, Compact, Forge, Made, Terrain

cloudpickle.register_pickle_by_value(cubiform)

Family = Compact | Terrain | Building | Forge


@dataclass(frozen=True)
class SearchConfig:
    """Between migrations an island breeds epoch generations. survivors, above zero: how many offspring

    of an island and a generation are evaluated, the best by a cheap key; compact programs alone have one.
    """

    seed: int = 44
    islands: int = 4
    population: int = 8
    elites: int = 2
    tournament: int = 3
    crossover_percent: int = 40
    shard: int = 0
    survivors: int = 0
    max_attempts: int = 1 << 40
    epoch: int = 5

    def check(self) -> SearchConfig:
        if not (4 <= self.population <= 16_384 and 1 <= self.elites < self.population and 2 <= self.tournament <= self.population and self.islands >= 1 and self.epoch >= 1):
            raise ValueError("population 4..16384, 1 <= elites < population, 2 <= tournament <= population, epoch >= 1")
        return self

    def attempts(self, generations: int) -> int:
        """Offspring of all islands after so many generations."""
        return generations * self.islands * (self.population - self.elites)


def key(encoding: bytes) -> bytes:
    """By this an island remembers an encoding."""
    return hashlib.sha256(encoding).digest()


def offspring(family: Family, people: list[Made], config: SearchConfig, stream: int, generation: int) -> list[tuple[Made, object]]:
    """(parent, child) for each place behind the elites: even streams cross, odd ones mutate more."""
    rng = ChaCha8.seeded(config.seed, stream, generation)
    genetic, found = stream % 2 == 0, []

    def parent() -> Made:
        return min(people[rng.below(len(people))] for _ in range(config.tournament))

    for _ in range(config.elites, config.population):
        chosen = parent()
        child = family.read(chosen[2])
        if genetic and rng.u32() % 100 < config.crossover_percent:
            child = family.cross(child, family.read(parent()[2]), rng)
        for _ in range(1 if genetic else 2 + rng.u32() % 3):
            child = family.mutate(child, rng)
        found.append((chosen, family.tidy(child)))
    return found


def evolve(family: Family, people: list[Made], seen: set[bytes], config: SearchConfig, stream: int, generations: range) -> tuple[list[Made], list[bytes]]:
    """An island after some generations, best first, and the keys of what it saw for the first time.

    A child that fails, or whose encoding the island has seen, leaves its place to its parent.
    """
    people, fresh = sorted(people), []
    for generation in generations:
        children = offspring(family, people, config, stream, generation)
        tried = range(len(children))
        if config.survivors:
            tried = set(sorted(tried, key=lambda i: (*family.rank(children[i][1]), i))[: config.survivors])
        placed = people[: config.elites]
        for i, (chosen, child) in enumerate(children):
            made = family.evaluate(child) if i in tried else None
            if made and (k := key(made[2])) not in seen:
                seen.add(k)
                fresh.append(k)
                placed.append(made)
            else:
                placed.append(chosen)
        people = sorted(placed)
    return people, fresh


# ---- tables --------------------------------------------------------------------------------

_POPULATION = "island long, slot long, bytes long, units long, encoding binary"
_STATE = f"{_POPULATION}, seen binary"


def _frame(island: int, people: list[Made], fresh: list[bytes]) -> pd.DataFrame:
    """An island's people by slot, and what it saw first, in rows of their own."""
    rows = [(island, slot, *p, None) for slot, p in enumerate(people)] + [(island, None, None, None, None, k) for k in fresh]
    return pd.DataFrame(rows, columns=["island", "slot", "bytes", "units", "encoding", "seen"]).astype({"slot": "Int64", "bytes": "Int64", "units": "Int64"})


def founders(family: Family, seed: object, config: SearchConfig, island: int) -> tuple[list[Made], list[bytes]]:
    """Slot 0 is the seed, the others single mutations of it; what fails is the seed again."""
    start = family.evaluate(seed)
    if start is None:
        raise ValueError("the seed can't be made exact")
    people, known = [start], {key(start[2])}
    for slot in range(1, config.population):
        rng = ChaCha8.seeded(config.seed, config.shard * config.islands + island, (1 << 32) + slot)
        child = family.mutate(seed, rng, MUTATIONS[(slot + island) % len(MUTATIONS)]) if isinstance(family, Compact) else family.mutate(seed, rng)
        made = family.evaluate(child)
        made = made if made and key(made[2]) not in known else start
        known.add(key(made[2]))
        people.append(made)
    return sorted(people), sorted(known)


def initial(spark: SparkSession, family: Family, seed: object, config: SearchConfig) -> DataFrame:
    """The state before the first generation: islands are founded by one task each."""
    config.check()

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for island in pdf["island"].tolist():
                yield _frame(island, *founders(family, seed, config, island))

    return spark.range(config.islands).select(F.col("id").alias("island")).repartition(config.islands, "island").mapInPandas(found, _STATE)


def step(state: DataFrame, family: Family, config: SearchConfig, first: int, last: int) -> DataFrame:
    """The state after generations first .. last: rows of the population, and rows of what was seen first.

    state: the last population, and everything seen before. Where an epoch begins, the best of all
    islands takes the last place of each island that hasn't its encoding. The family and the best
    candidate, both bounded by the limits of a scene, travel with the function.
    """
    migrates = (first - 1) % config.epoch == 0
    best = state.filter("slot is not null").orderBy("bytes", "units", "encoding").select("bytes", "units", "encoding").first()
    best = (best.bytes, best.units, bytes(best.encoding))

    def breed(pdf: pd.DataFrame) -> pd.DataFrame:
        island = int(pdf["island"].iloc[0])
        lives = pdf["slot"].notna()
        people = sorted((int(r.bytes), int(r.units), bytes(r.encoding)) for r in pdf[lives].itertuples())
        if migrates and all(p[2] != best[2] for p in people):
            people[-1] = best
        seen = {bytes(k) for k in pdf[~lives]["seen"]} | {key(p[2]) for p in people}
        return _frame(island, *evolve(family, people, seen, config, config.shard * config.islands + island, range(first, last + 1)))

    return state.groupBy("island").applyInPandas(breed, _STATE)


class Search:
    """A search that can be stopped and taken up again: the state after each epoch is a table below a folder."""

    def __init__(self, spark: SparkSession, folder: str, target: P.Scene | Family, config: SearchConfig):
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config.check()
        self.family = Compact(target) if isinstance(target, P.Scene) else target
        if config.survivors and not isinstance(self.family, Compact):
            raise ValueError("only compact programs can be ranked before they are evaluated")

    def _path(self, generation: int) -> str:
        return f"{self.folder}/generation={generation}"

    def _facts(self, root: str) -> dict:
        return json.loads(json.dumps({"config": asdict(self.config), "root": root, "family": type(self.family).__name__}))

    def _root(self) -> str:
        return root_of(self.family)

    def start(self, seed: object) -> None:
        facts = json.dumps(self._facts(self._root()), sort_keys=True)
        self.spark.createDataFrame([(facts,)], "facts string").coalesce(1).write.mode("errorifexists").text(f"{self.folder}/config")
        initial(self.spark, self.family, seed, self.config).write.parquet(self._path(0))

    def _state(self, generation: int) -> DataFrame:
        return self.spark.read.schema(_STATE).parquet(self._path(generation))

    def population(self, generation: int) -> DataFrame:
        return self._state(generation).filter("slot is not null").drop("seen")

    def epochs(self, begin: int, generations: int) -> list[tuple[int, int]]:
        """(first, last) generations of the epochs, begun ones included, that lead from one stored generation to another."""
        found, size = [], self.config.epoch
        while begin < generations:
            last = min((begin // size + 1) * size, generations)
            found.append((begin + 1, last))
            begin = last
        return found

    def run(self, generations: int, begin: int = 0) -> DataFrame:
        """Generations begin + 1 .. generations, by epochs; the population after the last that the attempts allow."""
        have = [g for g in self.stored() if g <= begin]
        for first, last in self.epochs(begin, generations):
            if self.config.attempts(first - 1) >= self.config.max_attempts:
                return self.population(first - 1)
            before = self.spark.read.schema(_STATE).parquet(*(self._path(g) for g in have)).filter("slot is null")
            step(self.population(have[-1]).withColumn("seen", F.lit(None).cast("binary")).unionByName(before), self.family, self.config, first, last).write.parquet(self._path(last))
            have.append(last)
        return self.population(generations)

    def stored(self) -> list[int]:
        """The generations that are stored whole, in order."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = []
        for s in fs.listStatus(path):
            name = s.getPath().getName()
            if name.startswith("generation=") and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                found.append(int(name.partition("=")[2]))
        return sorted(found)

    def resume(self, at: int, generations: int) -> DataFrame:
        """Takes up after a stored generation, once it is known to be of this search and untampered."""
        stored = json.loads(self.spark.read.text(f"{self.folder}/config").first()[0])
        if stored != self._facts(self._root()):
            raise ValueError("the stored search is another one")
        verify(self.population(at), self.family)
        return self.run(generations, at)

    def progress(self, generation: int) -> DataFrame:
        """By island: the best bytes, how many different encodings live, and how many were seen since the stored generation before."""
        state = self._state(generation)
        return state.groupBy("island").agg(F.min("bytes").alias("best_bytes"), F.count("seen").alias("fresh"), F.count_distinct("encoding").alias("different"))


def root_of(family: Family) -> str:
    """What a family's target is known by."""
    if isinstance(family, Compact):
        return family.target.root()
    if isinstance(family, Building):
        return P.Scene(family.size, family.voxels).root()
    if isinstance(family, Terrain):
        return key(repr((family.min_y, family.ids)).encode()).hex()
    return family.item.root()


def verify(population: DataFrame, target: P.Scene | Family) -> None:
    """Every stored candidate must be what its program, evaluated again, becomes: the target, with its bytes and units."""
    family = Compact(target) if isinstance(target, P.Scene) else target

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            bad = []
            for r in pdf.itertuples():
                try:
                    made = family.evaluate(family.read(bytes(r.encoding)))
                except FormatError:
                    made = None
                if made is None or made != (r.bytes, r.units, bytes(r.encoding)):
                    bad.append((r.island, r.slot))
            yield pd.DataFrame(bad, columns=["island", "slot"])

    if not population.mapInPandas(check, "island long, slot long").isEmpty():
        raise ValueError("a stored candidate doesn't draw the target")
