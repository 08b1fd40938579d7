"""The Spark path against the single-asset one; search; streams; plans."""

import random

import pytest
from pyspark.sql import functions as F

from cubiform import constants as K
from cubiform.operators import canonical, geometry, machine, search, state, variation
from cubiform.operators import random as numbers
from cubiform.operators import difference as D
from cubiform.plans import catalog
from cubiform.sources import assets, wire
from cubiform.sources import candidates as C
from cubiform.sources import programs as P
from cubiform.streaming import ingest
from tests.test_formats import BUILDINGS, FORGED, TERRAIN, random_program

COTTAGE = bytes.fromhex(BUILDINGS["cottage"][0])


def test_cottage_root_in_spark(spark):
    found = assets.commands(spark.createDataFrame([("cottage", COTTAGE)], "asset string, content binary"))
    dims = P.read_legacy(COTTAGE).size
    voxels = state.last_writer(geometry.draw(found, dims))
    row = canonical.building_roots(voxels, dims).first()
    assert (row.voxels, row.root) == (2510, BUILDINGS["cottage"][3])


def test_spark_draws_what_the_interpreter_draws(spark):
    random.seed(21)
    programs = {}
    while len(programs) < 25:
        programs[f"p{len(programs)}"] = random_program()
    rows = [assets._flat(n, i, op, p.size) for n, p in programs.items() for i, op in enumerate(p.ops)]
    names = [x.rsplit(" ", 1)[0] for x in assets.COMMAND_SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], assets.COMMAND_SCHEMA)
    got = {}
    for r in machine.run(df, (12, 12, 12)).collect():
        got.setdefault(r.scene, {})[r.id] = r.material
    assert got == {n: P.execute(p).voxels for n, p in programs.items()}
    assert machine.faults(df, ("dim_x", "dim_y", "dim_z")).count() == 0


def test_residual_costs_match_bytes(spark):
    random.seed(6)
    size, rows, want = (8, 4, 8), [], {}
    for n in range(40):
        ids = sorted(random.sample(range(256), random.randint(1, 120)))
        patches = [(i, kind := random.randint(0, 2), 0 if kind == 1 else random.choice([2, 5, 300])) for i in ids]
        palette = [2, 5, 300]
        want[n] = [len(b) for b in P.residuals(size, palette, patches)]
        rows += [(n, i, k, m, palette.index(m) if m else 0) for i, k, m in patches]
    df = spark.createDataFrame(rows, "scene long, id long, kind int, material long, index long")
    got = {r.scene: [r.sparse, r.runs, r.boxes, r.layers, r.xor, r.groups] for r in D.residual_costs(df, *size).collect()}
    assert got == want


def test_assets_table(spark):
    rows = [(f"building/{n}", bytes.fromhex(v[0])) for n, v in BUILDINGS.items()] + [(f"text/{n}", K.LEGACY_TEXT.encode() + wire.to_base64url(bytes.fromhex(v[0])).encode()) for n, v in BUILDINGS.items()]
    rows += [(f"forge/{n}", bytes.fromhex(v[0])) for n, v in FORGED.items()] + [(f"terrain/{n}", v[0]) for n, v in TERRAIN.items()] + [("building/bad", COTTAGE[:-1]), ("building/none", None)]
    found = {r.asset: r for r in assets.decoded(spark.createDataFrame(rows, "asset string, content binary")).collect()}
    for n, v in BUILDINGS.items():
        assert found[f"building/{n}"].root == v[3] == found[f"text/{n}"].root
    for n, v in FORGED.items():
        assert found[f"forge/{n}"].root == v[2]
    for n, v in TERRAIN.items():
        assert found[f"terrain/{n}"].root == v[2]
    assert found["building/bad"].error_kind == "Truncated" and found["building/none"].error_kind
    audit = {r.asset: r for r in assets.audited(spark.createDataFrame(rows[:5], "asset string, content binary")).collect()}
    assert audit["building/cottage"].compact_bytes == 57 and audit["building/normal"].selected == "source"


def test_accounts_without_python(spark):
    df = assets.accounts(spark.createDataFrame([(n, v[0]) for n, v in TERRAIN.items()], "asset string, content binary"))
    roots = {r.scene: r.root for r in canonical.terrain_roots(df.select(F.col("asset").alias("scene"), "min_y", "id")).collect()}
    assert roots == {n: v[2] for n, v in TERRAIN.items()}
    assert "Python" not in df._jdf.queryExecution().toString()
    row = bytearray(TERRAIN["row"][0])
    bad = {"magic": b"XCBK" + row[4:], "version": row[:4] + b"\2" + row[5:], "short": row[:-1], "record": row[:18] + b"\2" + row[19:], "none": None, "count": row[:6] + b"\xff" + row[7:], "tiny": b"NC"}
    df = spark.createDataFrame([(n, v and bytes(v)) for n, v in bad.items()] + [("fine", bytes(row))], "asset string, content binary")
    want = {}
    for n, v in bad.items():
        with pytest.raises(wire.FormatError) as e:
            C.read_account(bytes(v or b""))
        want[n] = (e.value.kind, e.value.code)
    assert {r.asset: (r.kind, r.code) for r in assets.account_faults(df).collect()} == want and {r.asset for r in assets.accounts(df).collect()} == {"fine"}


@pytest.mark.parametrize("partitions", [1, 13])
def test_partitions_do_not_matter(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = sorted(map(tuple, catalog.QUERIES["residual_best"](spark, "/root/testdata/sf0.001").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert rows == sorted(map(tuple, catalog.QUERIES["residual_best"](spark, "/root/testdata/sf0.001").collect()))


def test_flagship_moves_commands_and_not_cells(spark):
    """One exchange for the commands' order, one by scene; none after cells exist."""
    df = catalog.QUERIES["residual_best"](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    before = plan.index("Generate") if "Generate" in plan else len(plan)
    assert "Exchange" not in plan[:before].replace("AQEShuffleRead", "")
    assert "Python" not in plan


def test_chacha_block():
    """The key stream of the zero key, eight rounds: the first words of the published vectors."""
    rng = numbers.ChaCha8(bytes(32))
    first = b"".join(rng.u32().to_bytes(4, "little") for _ in range(4))
    assert first.hex() == "3e00ef2f895f40d67f5bb8e81f09a5a1"


def test_search_is_reproducible_and_resumes(spark, tmp_path):
    target = P.execute(P.read_legacy(bytes.fromhex(BUILDINGS["normal"][0])))
    seed = P.Program(target.size, [{"op": "box", "material": 7, "origin": (0, 0, 0), "size": (8, 2, 8)}, {"op": "box", "material": 7, "origin": (0, 2, 0), "size": (8, 2, 8)}], [7])
    config = search.SearchConfig(islands=2, population=6, elites=1, tournament=2, epoch=1)
    one = search.Search(spark, str(tmp_path / "a"), target, config)
    one.start(seed)
    rows = sorted(map(tuple, one.run(3).collect()))
    two = search.Search(spark, str(tmp_path / "b"), target, config)
    two.start(seed)
    two.run(1)
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    assert sorted(map(tuple, two.resume(1, 3).collect())) == rows
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    first = min(r.bytes for r in one.population(0).collect())
    assert min(r[2] for r in rows) <= first
    search.verify(one.population(3), target)
    with pytest.raises(ValueError):
        search.verify(one.population(3).withColumn("bytes", F.col("bytes") + 1), target)
    assert one.progress(3).count() == 2


def test_every_mutation_keeps_programs_valid():
    target = P.execute(P.read_legacy(COTTAGE))
    base = P.read_legacy(COTTAGE)
    fine = 0
    for k, kind in enumerate(variation.MUTATIONS):
        for s in range(3):
            made = variation.evaluate(variation.tidy(variation.mutate(base, numbers.ChaCha8.seeded(s, k, 0), kind)), target)
            fine += made is not None
    assert fine > len(variation.MUTATIONS)


def test_stream(spark, tmp_path):
    folder = tmp_path / "in" / "building"
    folder.mkdir(parents=True)
    (folder / "cottage.bin").write_bytes(COTTAGE)
    for name in ("variant", None):
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        if name:
            (folder / f"{name}.bin").write_bytes(bytes.fromhex(BUILDINGS[name][0]))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert {r.root for r in found.collect()} == {BUILDINGS["cottage"][3], BUILDINGS["variant"][3]} and found.count() == 2
