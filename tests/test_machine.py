"""Whole programs in Spark, their faults, and what baselines and searches make of scenes."""

import random

import pytest
from pyspark.sql import functions as F

from cubiform.operators import baselines, compress, corpus, geometry, machine, population, search, state, variation
from cubiform.operators import random as numbers
from cubiform.sources import assets, checkpoints, checks, envelopes, wire
from cubiform.sources import candidates as C
from cubiform.sources import forged as G
from cubiform.sources import programs as P
from tests.test_formats import BUILDINGS, FORGED, TERRAIN, random_program

COTTAGE = bytes.fromhex(BUILDINGS["cottage"][0])


def table(spark, programs):
    rows = [assets._flat(n, i, op, p.size) for n, p in programs.items() for i, op in enumerate(p.ops)]
    names = [x.rsplit(" ", 1)[0] for x in assets.COMMAND_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], assets.COMMAND_SCHEMA)


def outcomes(programs, limits):
    good, bad = {}, {}
    for n, p in programs.items():
        try:
            good[n] = P.execute(p, limits).voxels
        except wire.FormatError as e:
            bad[n] = (e.kind, e.code)
    return good, bad


def box(x, y, z, w, h, d, m=1):
    return {"op": "box", "material": m, "origin": (x, y, z), "size": (w, h, d)}


def test_faults_are_rows_and_cells_are_whole(spark):
    random.seed(3)
    size, limits = (12, 12, 12), {"max_writes": 3000, "max_op_expansion": 1500, "max_voxels": 1400, "max_commands": 12}
    programs = {f"p{i}": random_program() for i in range(12)}
    programs |= {
        "outside": P.Program(size, [box(0, 0, 0, 1, 1, 1), box(10, 0, 0, 4, 1, 1)]), "writes": P.Program(size, [box(0, 0, 0, 12, 9, 12)] * 3), "expansion": P.Program(size, [box(0, 0, 0, 12, 12, 12)]),
        "voxels": P.Program(size, [box(0, 0, 0, 12, 10, 12), box(0, 10, 0, 2, 1, 1)]), "full": P.Program(size, [box(0, 0, 0, 12, 9, 12)]), "many": P.Program(size, [box(0, 0, 0, 1, 1, 1)] * 13),
        "copy": P.Program(size, [box(0, 0, 0, 4, 1, 1), {"op": "translate", "source": (0, 0, 0), "size": (4, 1, 1), "delta": (11, 0, 0)}]), "vain": P.Program(size, [{"op": "clear_box", "origin": (0, 0, 0), "size": (2, 2, 2)}]),
    }
    good, bad = outcomes(programs, limits)
    assert len(bad) == 7
    df = table(spark, programs)
    for dims in (size, ("dim_x", "dim_y", "dim_z")):
        got = {}
        for r in machine.run(df, dims, limits).collect():
            got.setdefault(r.scene, {})[r.id] = r.material
        assert got == good
        assert {r.scene: (r.kind, r.code) for r in machine.faults(df, dims, limits).collect()} == bad


def test_no_box_vanishes_or_aliases(spark):
    """A large box is drawn whole; one that is too large, empty or outside is an error where cells are asked for."""
    dims = (128, 64, 128)
    large = table(spark, {"a": P.Program(dims, [box(0, 0, 0, 128, 32, 32)])})
    assert geometry.draw(large, dims).count() == 128 * 32 * 32
    for op in (box(0, 0, 0, 128, 64, 128), box(127, 0, 0, 2, 1, 1), box(0, 0, 0, 0, 1, 1)):
        df = table(spark, {"a": P.Program(dims, [op])})
        assert geometry.box_faults(geometry.boxes(df), dims).count() == 1
        with pytest.raises(Exception, match="box of scene a"):
            geometry.draw(df, dims).collect()
    moved = table(spark, {"a": P.Program(dims, [{"op": "translate", "source": (0, 0, 0), "size": (1, 1, 1), "delta": (1, 0, 0)}])})
    with pytest.raises(Exception, match="no boxes for the op translate"):
        geometry.draw(moved, dims).collect()


def test_bad_files_are_rows(spark):
    good = P.encode(P.Program((8, 8, 8), [box(0, 0, 0, 2, 2, 2)], [1], [(511, 0, 1)]))
    df = spark.createDataFrame([("building/a", good), ("building/b", good[:-1]), ("building/c", None)], "asset string, content binary")
    found = assets.commands(df)
    assert {(r.scene, r.op, r.error_kind is None) for r in found.collect()} == {("building/a", "box", True), ("building/b", None, False), ("building/c", None, False)}
    assert {r.scene for r in machine.faults(found, ("dim_x", "dim_y", "dim_z")).collect()} == {"building/b", "building/c"}
    patches = assets.residuals(df).filter("error_kind is null")
    cells = machine.run(found, ("dim_x", "dim_y", "dim_z"), patches=patches)
    assert {(r.id, r.material) for r in cells.collect()} == set(P.execute(P.decode(good)).voxels.items())
    assert assets.audited(df).filter("error_kind is not null").count() == 3


def test_slice_masks(spark):
    random.seed(2)
    scene = P.Scene((4, 3, 5), {i: random.randint(1, 2) for i in random.sample(range(60), 40)})
    voxels = spark.createDataFrame([(1, i, m) for i, m in scene.voxels.items()], "scene long, id long, material long")
    for axis in range(3):
        got = {r.material: (r.u, r.v, r.depth, r.cells) for r in baselines.slice_extrusions(voxels, axis, scene.size).collect()}
        u, v = (scene.size[k] for k in P.TANGENTS[axis])
        assert got == {m: (u, v, scene.size[axis], [i for i, bit in enumerate(mask) if bit]) for m, mask in compress.slice_masks(scene, axis).items()}
    bars = P.execute(P.Program((6, 6, 6), [{"op": "extrude", "material": 3, "origin": (0, 0, 0), "axis": 1, "u": 6, "v": 6, "depth": 6, "mask": [i % 5 // 3 for i in range(36)]}]))
    best = C.read_building(compress.building(bars))
    assert [op["op"] for op in best.ops] == ["extrude"] and not best.patches


def test_greedy_boxes_like_plain_growth(spark):
    random.seed(5)
    dims, rows, want = (5, 4, 6), [], {}
    for n in range(8):
        cells = {i: random.randint(1, 2) for i in random.sample(range(120), random.randint(1, 110))}
        rows += [(n, i, m) for i, m in cells.items()]
        left, found = dict(cells), []
        at = lambda x, y, z: x + 5 * (z + 6 * y)
        for i in sorted(cells):
            if i in left:
                x, z, y, m = i % 5, i // 5 % 6, i // 30, left[i]
                w = next((k for k in range(1, 6) if x + k == 5 or left.get(at(x + k, y, z)) != m), 5)
                d = next((k for k in range(1, 7) if z + k == 6 or any(left.get(at(a, y, z + k)) != m for a in range(x, x + w))), 6)
                h = next((k for k in range(1, 5) if y + k == 4 or any(left.get(at(a, y + k, b)) != m for a in range(x, x + w) for b in range(z, z + d))), 4)
                for c in [at(a, b, e) for a in range(x, x + w) for b in range(y, y + h) for e in range(z, z + d)]:
                    del left[c]
                found.append((m, x, y, z, w, h, d))
        want[n] = sorted(found)
    got = {}
    for r in baselines.greedy_boxes(spark.createDataFrame(rows, "scene long, id long, material long"), dims).collect():
        got.setdefault(r.scene, []).append((r.material, r.x, r.y, r.z, r.w, r.h, r.d))
    assert {n: sorted(v) for n, v in got.items()} == want


def test_terrain_bytes_are_those_written(spark):
    random.seed(7)
    rows, want = [], {}
    for n in range(20):
        ids = sorted(random.sample(range(3000 if n % 2 else C.UNIVERSE), random.randint(1, 400)))
        min_y = random.randint(-70, 70)
        rows += [(n, i, min_y) for i in ids]
        runs, layers = [], {}
        for i in ids:
            runs, _ = ([*runs[:-1], (runs[-1][0], runs[-1][1] + 1)], 0) if runs and sum(runs[-1]) == i else ([*runs, (i, 1)], 0)
            layers.setdefault(i // 256, [0] * 256)[i % 256] = 1
        made = [C.TerrainProgram(min_y, [], [(i, 0) for i in ids]), C.TerrainProgram(min_y, [{"op": "elias_fano", "values": ids}]), C.TerrainProgram(min_y, [{"op": "delete_run", "start": s, "length": k} for s, k in runs]), C.TerrainProgram(min_y, [{"op": "layer", "y": y, "mask": m} for y, m in layers.items()])]
        want[n] = [len(C.write_terrain(p)) for p in made]
    got = {r.scene: [r.sparse, r.split, r.runs, r.layers] for r in baselines.terrain_bytes(spark.createDataFrame(rows, "scene long, id long, min_y long")).collect()}
    assert got == want


def test_large_terrains_try_every_cover():
    """Above twenty thousand cells, too, the bounding box and the greedy cover are candidates."""
    cells = {x + 16 * (z + 16 * y) for y in range(100) for z in range(16) for x in range(15)}
    best = C.read_terrain(compress.terrain(0, cells))
    assert [op["op"] for op in best.ops] == ["delete_box"] and C.run_terrain(best)[0] == cells


# ---- limits and meanings -------------------------------------------------------------------


def test_task_limits_bind_verification():
    data, _, _ = TERRAIN["cavity"]
    fair = envelopes.Task("terrain_delta", "a", "chunkbroken-v1", data)
    small = corpus.smallest(data, "terrain_delta")
    assert envelopes.verify(fair, envelopes.Result(fair.task_id, small, "terrain_delta"))["exact"]
    for name, value in (("max_voxels", 10), ("max_writes", 10), ("max_input_bytes", 20), ("max_decode_units", 20)):
        task = envelopes.Task("terrain_delta", "a", "chunkbroken-v1", data, fair.target().root, {k: v for k, v in fair.limits.items()} | {name: value})
        with pytest.raises(wire.FormatError) as e:
            envelopes.verify(task, envelopes.Result(task.task_id, small, "terrain_delta"))
        assert e.value.kind == "ResourceLimit"
    with pytest.raises(wire.FormatError) as e:
        envelopes.verify(fair, envelopes.Result(fair.task_id, corpus.smallest(COTTAGE, "building"), "terrain_delta"))
    assert e.value.kind == "ProfileMismatch"


@pytest.mark.parametrize("check,kind", [
    (lambda: checks.limits({k: v[0] for k, v in checks.K.LIMITS.items()} | {"max_memory_bytes": 1}), "ResourceLimit"), (lambda: checks.terrain([3, 3]), "NonCanonical"),
    (lambda: checks.terrain([C.UNIVERSE]), "OutOfBounds"), (lambda: checks.building((2, 2, 2), [(0, 1), (8, 1)]), "OutOfBounds"), (lambda: checks.building((2, 2, 2), [(0, 0)]), "OutOfBounds"),
    (lambda: checks.building((2, 2, 2), [(0, 1), (1, 2)], {"max_materials": 1}), "ResourceLimit"), (lambda: checks.building((513, 2, 2), []), "OutOfBounds"),
    (lambda: checks.patch_capacity(5, 0), "ResourceLimit"), (lambda: checks.patch_capacity(131_072, 1), "ResourceLimit"), (lambda: checks.patch_capacity(0, 200, {"max_memory_bytes": 1599}), "ResourceLimit"),
    (lambda: checks.forged(G.Forged(0, 0, bytes([64] + [0] * 11))), "OutOfBounds"), (lambda: checks.forged(G.Forged(0, 0, bytes(12))), "OutOfBounds"),
])
def test_validators(check, kind):
    with pytest.raises(wire.FormatError) as e:
        check()
    assert e.value.kind == kind


def test_validators_let_good_ones_through():
    checks.limits(checks.merged(None))
    assert checks.patch_capacity(3, 4, {"max_memory_bytes": 56}) == 7
    for payload, *_ in FORGED.values():
        checks.forged(G.read_forged(bytes.fromhex(payload)))


def test_an_adapter_carries_envelopes_only():
    data, _, _ = TERRAIN["row"]
    network = ("net", 7, None)
    task = envelopes.Task("terrain_delta", "row", "chunkbroken-v1", data, network=network)

    class Chain:
        def fetch_task(self, asked):
            return task.to_bytes()

        def submit_result(self, sent, result):
            return sent, result

    sent, result = envelopes.answer(Chain(), network, lambda t: corpus.smallest(t.incumbent, t.profile))
    assert sent == task.to_bytes() and envelopes.verify(task, envelopes.read_result(result, "terrain_delta"))["accepted"]
    with pytest.raises(wire.FormatError):
        envelopes.answer(Chain(), ("other", 7, None), lambda t: b"")
    with pytest.raises(wire.FormatError):
        envelopes.answer(Chain(), network, lambda t: C.write_terrain(C.TerrainProgram(-64, [])))


# ---- search --------------------------------------------------------------------------------


def families():
    scene = P.execute(P.read_legacy(COTTAGE))
    min_y, cells = C.read_account(TERRAIN["cavity"][0])
    item = G.read_forged(bytes.fromhex(FORGED["cavity"][0]))
    return {
        "compact": (variation.Compact(scene), P.read_legacy(COTTAGE)), "terrain": (variation.Terrain(min_y, cells), [{"op": "delete_run", "start": i, "length": 1} for i in sorted(cells)]),
        "building": (variation.Building(scene), [{"op": "box", "material": m, "origin": o, "size": s} for m, o, s in compress.grown_boxes(scene.voxels, scene.size, lambda x, y, z: x + 32 * (z + 32 * y), lambda i: (i % 32, i // 1024, i // 32 % 32), (0, 2, 1))]),
        "forge": (variation.Forge(item), [[{"op": "sparse", "cells": set(c.cells)}] for c in item.components]),
    }


@pytest.mark.parametrize("name", ["compact", "terrain", "building", "forge"])
def test_evolution_gets_smaller_and_stays_exact(name):
    family, seed = families()[name]
    config = search.SearchConfig(islands=1, population=8, elites=2, tournament=2)
    people, seen = search.founders(family, seed, config, 0)
    after, fresh = search.evolve(family, people, set(seen), config, 0, range(1, 7))
    again, _ = search.evolve(family, *(lambda a: (a[0], set(seen) | set(a[1])))(search.evolve(family, people, set(seen), config, 0, range(1, 4))), config, 0, range(4, 7))
    assert after == again and after[0] <= people[0] and fresh and len(set(fresh)) == len(fresh)
    for p in after:
        assert family.evaluate(family.read(p[2])) == p
    if name == "terrain":
        assert after[0][0] < people[0][0]


def test_every_mutation_of_the_first_machine():
    """Of many draws, all kinds of commands appear, and most offspring can be made exact."""
    kinds, fine = {}, {}
    for name, (family, seed) in families().items():
        if name == "compact":
            continue
        for s in range(60):
            child = family.mutate(seed, numbers.ChaCha8.seeded(s, 1, 1))
            for op in child if name != "forge" else [op for ops in child for op in ops]:
                kinds.setdefault(name, set()).add(op["op"])
            fine[name] = fine.get(name, 0) + (family.evaluate(child) is not None)
    assert kinds["terrain"] == {"delete_run", "delete_box", "layer", "elias_fano"} and kinds["building"] == {"box", "run", "cut", "literal", "wall"}
    assert kinds["forge"] == {"solid", "rle", "sparse", "extrude", "symmetry", "cut_box"} and all(n > 40 for n in fine.values())


def test_crossing_and_tidying():
    (terrain, _), (building, _), (forge, _) = (families()[n] for n in ("terrain", "building", "forge"))
    rng = lambda s: numbers.ChaCha8.seeded(s, 0, 0)
    runs = [{"op": "delete_run", "start": 0, "length": 2}, {"op": "delete_run", "start": 2, "length": 3}, {"op": "layer", "y": 1, "mask": [1] * 256}, {"op": "delete_run", "start": 9, "length": 1}]
    assert terrain.tidy(runs) == [{"op": "delete_run", "start": 0, "length": 5}, *runs[2:]]
    one, two, three = box(0, 0, 0, 2, 2, 2), box(2, 0, 0, 1, 2, 2), box(0, 2, 0, 3, 1, 2)
    assert variation.joined_boxes([three, one, {"op": "cut"}, two]) == [box(0, 0, 0, 3, 3, 2), {"op": "cut"}]
    assert variation.joined(one, box(2, 0, 0, 1, 2, 2, 9)) is None and variation.joined(one, box(3, 0, 0, 1, 2, 2)) is None
    left, right = [box(x, 0, 0, 1, 1, 1, 1) for x in range(32)], [box(x, 0, 0, 1, 1, 1, 2) for x in range(32)]
    for s in range(5):
        child = building.cross(left, right, rng(s))
        plane = max(op["origin"][0] for op in child if op["material"] == 1)
        assert [op["material"] for op in child] == [1] * (plane + 1) + [2] * (31 - plane)
    assert forge.cross([[1, 2]], [[3]], rng(0))[0] in ([3], [1, 3], [1, 2, 3], [], [1], [1, 2])


def test_rank_key_in_python_and_in_spark(spark):
    """The key of a program, ranked one by one, is that of the table."""
    random.seed(8)
    target = P.execute(P.read_legacy(COTTAGE))
    base = P.read_legacy(COTTAGE)
    rows, want = [], []
    for i in range(12):
        p = variation.mutate(variation.mutate(base, numbers.ChaCha8.seeded(i, 0, 0)), numbers.ChaCha8.seeded(i, 0, 1))
        key = variation.rank_key(p, target)
        want.append((*key, i))
        if key[0]:
            rows.append((0, i, False, 0, 0, 0, 0, len(p.ops), 0, 1))
            continue
        differ = P.difference(target.voxels, P.execute(P.Program(p.size, p.ops)).voxels)
        sets, paints = (sum(k == n for _, k, _ in differ) for n in (0, 2))
        masks = sum(-(-len(op.get("mask", ())) // 8) for op in p.ops)
        rows.append((0, i, True, len(differ), sets, paints, len(P._stretches(differ)), len(p.ops), masks, 32 * 24 * 32))
    df = spark.createDataFrame(rows, "island long, slot long, valid boolean, mismatches long, sets long, paints long, runs long, ops long, mask_bytes long, volume long")
    best = population.survivors(df, 5).orderBy("rank").collect()
    assert [r.slot for r in best] == [w[-1] for w in sorted(want)[:5]] and [r.cost for r in best if r.valid] == [w[1] for w in sorted(want)[:5] if not w[0]]


def test_a_search_of_the_first_machine_resumes(spark, tmp_path):
    family, seed = families()["terrain"]
    config = search.SearchConfig(islands=3, population=6, elites=1, tournament=2, epoch=2)
    one, two = (search.Search(spark, str(tmp_path / n), family, config) for n in "ab")
    one.start(seed)
    rows = sorted(map(tuple, one.run(5).collect()))
    two.start(seed)
    two.run(3)
    assert sorted(map(tuple, two.resume(3, 5).collect())) == rows
    assert one.stored() == [0, 2, 4, 5] and two.stored() == [0, 2, 3, 4, 5]
    assert one.progress(5).agg(F.min("best_bytes")).first()[0] == min(r[2] for r in rows)
    with pytest.raises(ValueError):
        search.Search(spark, str(tmp_path / "b"), family, search.SearchConfig(islands=3, population=6, elites=1, tournament=2, epoch=3)).resume(3, 5)
    with pytest.raises(ValueError):
        search.Search(spark, str(tmp_path / "c"), family, search.SearchConfig(survivors=2))


def test_survivors_are_evaluated_alone():
    family, seed = families()["compact"]
    config = search.SearchConfig(islands=1, population=8, elites=1, tournament=2, survivors=2)
    people, seen = search.founders(family, seed, config, 0)
    _, fresh = search.evolve(family, people, set(seen), config, 0, range(1, 2))
    assert len(fresh) <= 2


# ---- checkpoints ---------------------------------------------------------------------------


def test_checkpoints_of_the_machine():
    data, _, _ = TERRAIN["cavity"]
    task = envelopes.Task("terrain_delta", "cavity", "chunkbroken-v1", data)
    task.root = task.target().root
    family, seed = families()["terrain"]
    config = search.SearchConfig(islands=2, population=4, elites=1, tournament=2)
    islands = [[p[2] for p in search.founders(family, seed, config, i)[0]] for i in range(2)]
    worst = max((e for i in islands for e in i), key=len)
    c = checkpoints.machine(task, {"islands": 2, "population": 4}, 3, 24, worst, islands)
    assert checkpoints.read_machine(checkpoints.write_machine(c)) == c
    best = compress.terrain(*C.read_account(data))
    merged = checkpoints.migrate_machine(c, checkpoints.machine(task, {"islands": 2, "population": 4}, 9, 99, best))
    assert bytes(merged["bestEncoding"]) == best and all(best == bytes(i["population"][0]["encoding"]) for i in merged["islands"])
    for change in ({"vmVersion": 2}, {"taskId": [0] * 32}, {"islands": c["islands"][:1]}, {"bestEncoding": list(worst[:-1])}, {"generation": 4}):
        with pytest.raises(wire.FormatError):
            checkpoints.write_machine(c | change)
    for broken in (b"NCPC1\n{", b"NCPC2\n{}", b"NCPC1\n[]", b"NCPC1\n{}"):
        with pytest.raises(wire.FormatError):
            checkpoints.read_machine(broken)


def test_checkpoints_of_the_compact_kind():
    import json

    seed = P.encode(P.read_legacy(COTTAGE))
    family = variation.Compact(P.execute(P.read_legacy(COTTAGE)))
    poor = family.evaluate(P.Program(family.target.size, P.read_legacy(COTTAGE).ops[:-1], P.read_legacy(COTTAGE).palette))[2]
    config = {"islands": 1, "population": 2}
    c = checkpoints.compact(COTTAGE, "ncm3-v1", config, 0, 0, poor, [[poor, poor]], [[]])
    data = checkpoints.write_compact(c)
    assert checkpoints.read_compact(data) == c
    first = json.loads(data[6:])
    first["state"]["searchVersion"] = 1
    del first["state"]["evaluator"]
    assert checkpoints.read_compact(b"NC4S1\n" + json.dumps(first).encode()) == c
    merged = checkpoints.migrate_compact(c, checkpoints.compact(COTTAGE, "ncm3-v1", config, 5, 8, seed, [[seed, seed]], [[]]))
    assert bytes(merged["state"]["best"]["encoding"]) == seed and [bytes(p["encoding"]) for p in merged["state"]["islands"][0]["population"]] == [seed, poor]
    for change in ({"searchVersion": 3}, {"sourceBytes": 1}, {"islands": []}, {"evaluator": {"gpuBatchSize": 0, "gpuSurvivorsPerIsland": 1}}):
        with pytest.raises(wire.FormatError):
            checkpoints.write_compact({"state": c["state"] | change})
