"""What made queries too slow for larger tables: work that grows faster than scenes, and Python work in one task."""

import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from cubiform import constants as K
from cubiform.operators import compress, corpus, geometry, machine, state, variation
from cubiform.operators.random import ChaCha8
from cubiform.plans import adapters, codecs
from cubiform.sources import candidates as C
from cubiform.sources import envelopes, forged, wire
from cubiform.sources import programs as P
from cubiform.sources.assets import dicts


def _terrain_tries(cells):
    """All covers of a terrain, as programs without patches."""
    ids, runs = sorted(cells), []
    for i in ids:
        if runs and sum(runs[-1]) == i:
            runs[-1][1] += 1
        else:
            runs.append([i, 1])
    layers = {y: {i % 256 for i in ids if i // 256 == y} for y in sorted({i // 256 for i in ids})}
    yield []
    yield [{"op": "elias_fano", "values": ids}]
    yield from ([{"op": "delete_run", "start": s, "length": n} for s, n in runs if n >= least] for least in (1, 2, 3, 4))
    yield from ([{"op": "layer", "y": y, "mask": [int(p in b) for p in range(256)]} for y, b in layers.items() if len(b) >= least] for least in (1, 32, 64, 128))
    at = [(i % 16, i // 256, i // 16 % 16) for i in ids]
    low, high = [min(c) for c in zip(*at)], [max(c) for c in zip(*at)]
    yield [{"op": "delete_box", "origin": tuple(low), "size": tuple(h - a + 1 for a, h in zip(low, high))}]
    boxes = compress.grown_boxes(dict.fromkeys(ids, 1), K.TERRAIN_GRID, lambda x, y, z: x + 16 * (z + 16 * y), lambda i: (i % 16, i // 256, i // 16 % 16), (0, 2, 1))
    yield [{"op": "delete_box", "origin": o, "size": s} for _, o, s in boxes]


def test_terrain_sizes_are_counted_not_written(monkeypatch):
    rng = random.Random(3)
    box = {x + 16 * (z + 16 * y) for x in range(2, 9) for y in range(40, 44) for z in range(3, 11)}
    scenes = [{0, 131071}, {rng.randrange(131072) for _ in range(40)}, box, box - {min(box) + 1}, {i for s in (5, 900, 70000) for i in range(s, s + 9)}]
    scenes.append({256 * y + p for y in (1, 300) for p in range(0, 256, 2)})
    for cells in scenes:
        made = []
        for ops in _terrain_tries(cells):
            have, _ = C.run_terrain(C.TerrainProgram(-5, ops))
            made.append(C.write_terrain(C.TerrainProgram(-5, ops, sorted([(i, 0) for i in cells - have] + [(i, 1) for i in have - cells]))))
        smallest = min(made, key=lambda b: (len(b), b))
        written, write = [], C.write_terrain
        monkeypatch.setattr(C, "write_terrain", lambda p: written.append(p) or write(p))  # noqa: B023
        assert compress.terrain(-5, cells) == smallest
        monkeypatch.undo()
        assert len(written) == sum(len(b) == len(smallest) for b in made)


def test_masks_and_sizes():
    for n in (1, 7, 8, 9, 300):
        mask = [int(i % 3 == 0) for i in range(n)]
        assert wire.read_mask(wire.Bytes(wire.pack_mask(mask)), n) == mask
    for v in (0, 127, 128, 16383, 16384, 1 << 21, (1 << 32) - 1):
        assert wire.varint_size(v) == len(wire.varint(v))
    for n in (1, 2, 67, 5000, 131072):
        assert C.elias_fano_size(n) == len(C.write_elias_fano(list(range(n))))


def test_scenes_are_worked_on_in_several_tasks(spark):
    rows = adapters.terrain(spark, "/root/testdata/sf0.001")
    assert codecs._gathered(rows, "scene", ["id", "min_y"]).rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism


def _account(ids):
    records = b"".join((i % 16 | (i // 16 % 16) << 4 | (i // 256) << 8).to_bytes(3, "little") for i in sorted(ids))
    return K.ACCOUNT_MAGIC.encode() + bytes([1, 0, len(ids), 0, 64, 0, 0, 0, 0, 0, 0, 0]) + records.ljust(192, b"\0")


def test_a_measured_account_writes_no_box_around_far_cells(monkeypatch):
    patches, write = [], C.write_terrain
    monkeypatch.setattr(C, "write_terrain", lambda p: patches.append(len(p.patches)) or write(p))
    found = corpus.measured("terrain/1", _account({0, 700, 131071}))
    assert (found["facts"], max(patches)) == (3, 3) and found["machine_bytes"] < found["source_bytes"]


def test_verified_results_come_from_several_tasks_without_large_boxes(spark, monkeypatch):
    assert codecs._accounts(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism
    patches, write = [], C.write_terrain
    monkeypatch.setattr(C, "write_terrain", lambda p: patches.append(len(p.patches)) or write(p))
    data = _account({0, 700, 131071})
    task = envelopes.read_task(envelopes.Task("terrain_delta", "1", K.ACCOUNT, data).to_bytes())
    for gone in (0, 1, 2):
        min_y, cells = C.read_account(data)
        sent = envelopes.Result(task.task_id, compress.terrain(min_y, set(sorted(cells)[gone:])), "terrain_delta")
        report = envelopes.verify(task, envelopes.read_result(sent.to_bytes(), "terrain_delta"))
        assert (report["exact"], report["mismatches"]) == (not gone, gone)
    assert max(patches) <= 3


def test_forged_covers_that_cannot_win_are_not_run(monkeypatch):
    ran, run = [], C.run_forge
    monkeypatch.setattr(C, "run_forge", lambda ops, patches: ran.append(ops) or run(ops, patches))
    cells = [3, 500, 777, 1959]
    item = forged.Forged(10, 7, bytes(range(12)), [forged.Component(2, 0x123, (8, 9, 10), (0, -1, 2), None, cells)])
    data = compress.forged(item)
    assert [op["op"] for ops in ran for op in ops] == ["sparse"]
    assert C.read_forge(data)[0].components[0].cells == cells
    assert C.run_lengths({0, 1, 5, 1959}) == (1, [2, 3, 1, 1953, 1]) and C.run_lengths(set()) == (0, [1960]) and C.run_lengths(set(range(1960))) == (1, [1960])


def test_copies_read_the_cells_there_are_not_the_whole_region(monkeypatch):
    asked, cells = [], P.ids_in
    monkeypatch.setattr(P, "ids_in", lambda *a: asked.append(a) or cells(*a))
    ops = [{"op": "box", "material": 3, "origin": (1, 2, 3), "size": (2, 1, 1)}, {"op": "translate", "source": (0, 0, 0), "size": (24, 24, 24), "delta": (4, 1, 2)}]
    ops.append({"op": "rotate_y", "source": (0, 0, 0), "size": (24, 24, 24), "target": (8, 8, 8), "turns": 1})
    scene = P.execute(P.Program((32, 32, 32), ops))
    place = lambda x, y, z: x + 32 * (z + 32 * y)
    first, second = [(1, 2, 3), (2, 2, 3)], [(5, 3, 5), (6, 3, 5)]
    assert scene.voxels == dict.fromkeys([place(*c) for c in (*first, *second, *((8 + 23 - z, 8 + y, 8 + x) for x, y, z in (*first, *second)))], 3)
    assert len(asked) == 1


def test_whole_programs_run_in_several_tasks(spark):
    drawn = machine._interpreted(machine._parts(codecs.mixed(spark, "/root/testdata/sf0.001"))[1], (32, 32, 32), None)
    assert drawn.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism


def test_many_integers_in_one_go():
    values = [0, 1, 127, 128, 16383, 16384, 1 << 21, (1 << 32) - 1, 5]
    assert wire.varints(np.array(values)) == b"".join(map(wire.varint, values)) and wire.varints(np.array([], np.int64)) == b""
    scene = P.Scene((64, 64, 64), {200000: 300, 3: 1, 5: 65535})
    assert scene.canonical() == b"".join(map(wire.varint, (64, 64, 64, 3, 3, 1, 1, 65535, 199994, 300)))


def test_rows_of_scenes_come_by_column():
    lists = pa.array([[{"a": 1, "m": [0, 1]}, {"a": None, "m": None}], [], [{"a": 3, "m": []}]], pa.list_(pa.struct([("a", pa.int64()), ("m", pa.list_(pa.int64()))])))
    assert dicts(lists) == lists.to_pylist() and dicts(lists[1:]) == lists[1:].to_pylist()


def test_building_covers_that_cannot_win_are_not_run(monkeypatch):
    ran, run = [], C.run_building
    monkeypatch.setattr(C, "run_building", lambda p, *limits: ran.append([op["op"] for op in p.ops]) or run(p, *limits))
    ops = [{"op": "box", "material": m, "origin": o, "size": (3, 4, 5)} for m, o in ((2, (0, 0, 0)), (3, (20, 20, 20)))]
    scene = P.execute(P.Program((32, 32, 32), ops))
    data = compress.building(scene)
    assert ran == [["box", "box"]] * 2 or ran == [["box", "box"]]
    assert run(C.read_building(data)).voxels == scene.voxels
    # An extrusion, a run and a literal where they are the smallest.
    mask = [int(i % 3 == 0) for i in range(64)]
    for op, kind in (({"op": "extrude", "axis": 1, "u": 8, "v": 8, "depth": 8, "mask": mask}, "extrude"), ({"op": "run", "axis": 2, "length": 8}, "box")):
        scene = P.execute(P.Program((8, 8, 8), [op | {"material": 4, "origin": (0, 0, 0)}]))
        assert {o["op"] for o in C.read_building(compress.building(scene)).ops} <= {kind, "run"}


def test_cells_in_numpy_are_those_of_the_plan(spark, monkeypatch):
    rows = [(s, q, m, *o, 1 + q % 3, 2, 1 + s % 4) for s in range(9) for q, m, o in ((1, 5, (s, 2, 3)), (2, 0, (s + 1, 2, 3)), (3, 7, (0, s % 5, 6)))]
    commands = spark.createDataFrame(rows, "scene long, seq long, material long, ox long, oy long, oz long, sx long, sy long, sz long")
    want = sorted(map(tuple, state.last_writer(geometry.draw(commands, (16, 16, 16), "box")).select("scene", "id", "material").collect()))
    for chunk in (1, 40, 1 << 20):
        monkeypatch.setattr(geometry, "_CHUNK", chunk)
        assert sorted(map(tuple, geometry.voxels(commands, (16, 16, 16), "box").collect())) == want
    assert "Generate explode" not in geometry.voxels(commands, (16, 16, 16), "box")._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="leaves the scene"):
        geometry.voxels(commands, (8, 16, 16), "box").collect()
    assert geometry.voxels(commands.limit(0), (16, 16, 16), "box").collect() == []


def test_decoded_programs_of_all_commands_are_written_in_several_tasks(spark):
    made = codecs._listed(spark, "/root/testdata/sf0.001", lambda p: (P.encode(p),), "scene long, content binary")
    assert made.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism


def test_boxes_are_not_grown_where_cells_stand_alone(monkeypatch):
    grown, grow = [], compress.grown_boxes
    monkeypatch.setattr(compress, "grown_boxes", lambda *a: grown.append(len(a[0])) or grow(*a))
    rng = random.Random(5)
    far, box = {rng.randrange(131072) for _ in range(70)}, {x + 16 * (z + 16 * y) for x in range(2, 9) for y in range(40, 44) for z in range(3, 11)}
    made = [compress.terrain(-5, cells) for cells in (far, box, box | far)]
    assert len(box) in grown and len(far) not in grown
    for cells, data in zip((far, box, box | far), made):
        assert C.run_terrain(C.read_terrain(data))[0] == cells


def test_an_account_is_read_without_a_step_for_each_cell():
    counts = []
    for ids in ([0, 15, 16, 255, 256, 700, 131071], range(0, 6000, 100)):
        steps: list[str] = []
        data = _account(ids)
        assert C.read_account(data) == (0, set(ids))
        sys.setprofile(lambda frame, event, arg: steps.append(event))  # noqa: B023
        C.read_account(data)
        sys.setprofile(None)
        counts.append(len(steps))
    assert counts[0] == counts[1]
    assert C.terrain_canonical(-5, {200000, 3, 5}) == b"".join(map(wire.varint, (9, 3, 3, 1, 199994)))
    with pytest.raises(wire.FormatError, match="record"):
        C.read_account(data[:16] + b"\0\0\2" + data[19:])


def test_parents_and_blocks_of_numbers_are_made_once(monkeypatch):
    scene = P.Scene((8, 8, 8), {i: 3 for i in range(4)})
    program = P.Program((8, 8, 8), [{"op": "run", "material": 3, "origin": (0, 0, 0), "axis": 0, "length": 4}], [3])
    read, decode = [], P.decode
    monkeypatch.setattr(P, "decode", lambda data: read.append(data) or decode(data))
    family, data = variation.Compact(scene), P.encode(program)
    first, again = family.read(data), family.read(data)
    first.ops.clear()
    assert len(read) == 1 and again.ops == family.read(data).ops == program.ops
    filled, make = [], ChaCha8._made
    monkeypatch.setattr(ChaCha8, "_made", lambda self: filled.append(1) or make(self))
    words = [[rng.u32() for _ in range(40)] for rng in (ChaCha8.seeded(987654, 3, 5), ChaCha8.seeded(987654, 3, 5))]
    assert words[0] == words[1] and len(filled) == 3 and len(set(words[0])) == 40
