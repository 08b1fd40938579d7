"""Many programs at once are what they are one by one: bytes, cells, roots and errors."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cubiform.operators import machine
from cubiform.plans import codecs
from cubiform.sources import batches as B
from cubiform.sources import programs as P
from cubiform.sources.assets import COMMAND_SCHEMA, _flat, listed_op
from cubiform.sources.wire import FormatError

DIMS = (32, 32, 32)
_KINDS = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}


def _op(rng: random.Random) -> dict:
    at = lambda n: tuple(rng.randrange(n) for _ in range(3))
    kind, axis = rng.choice(["box", "run", "wall", "extrude", "repeat_box", "gable", "tree", "fence", "translate", "rotate_y", "mirror", "clear_box"]), rng.randrange(3)
    u, v = rng.randrange(1, 6), rng.randrange(1, 6)
    op = {
        "box": {"size": tuple(1 + n for n in at(5))}, "run": {"axis": axis, "length": rng.randrange(1, 12)}, "wall": {"axis": axis, "u": u, "v": v, "thickness": rng.randrange(1, 4)},
        "extrude": {"axis": axis, "u": u, "v": v, "depth": rng.randrange(1, 9), "mask": [1, *(rng.randrange(2) for _ in range(u * v - 1))]},
        "repeat_box": {"size": tuple(1 + n for n in at(3)), "count": rng.randrange(2, 5), "delta": tuple(n - 2 for n in at(5))},
        "gable": {"style": rng.randrange(3), "z_oriented": rng.randrange(2), "width": rng.randrange(1, 9), "depth": rng.randrange(1, 9)},
        "tree": {"leaf": rng.randrange(1, 99), "height": rng.randrange(2, 10), "crown": rng.randrange(1, 5)}, "fence": {"axis": axis % 2, "length": rng.randrange(1, 9), "spacing": rng.randrange(1, 5)},
        "translate": {"source": at(4), "size": tuple(20 + n for n in at(9)), "delta": tuple(n - 1 for n in at(5))},
        "rotate_y": {"source": at(4), "size": (24, 24, 24), "target": at(9), "turns": 1 + axis}, "mirror": {"source": (0, 0, 0), "size": (24, 24, 24), "target": at(9), "axis": axis}, "clear_box": {"size": (9, 9, 9)},
    }[kind]
    return {"op": kind, **({} if "source" in op or kind == "clear_box" else {"material": rng.choice([1, 2, 90, 300]) if rng.random() < 0.1 else rng.randrange(1, 9)}), **({} if "source" in op else {"origin": at(20)}), **op}


def _drawn(data: bytes):
    try:
        scene = P.execute(P.decode(data))
        return len(scene.voxels), scene.root()
    except FormatError as e:
        return e.kind, e.code


def test_many_programs_are_the_same_as_each():
    rng = random.Random(7)
    programs = [[_op(rng) for _ in range(rng.randrange(1, 7))] for _ in range(600)]
    rows = [_flat("x", k, op, DIMS) for ops in programs for k, op in enumerate(ops)]
    fields = [x.rsplit(" ", 1) for x in COMMAND_SCHEMA.split(", ")]
    batch = pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _KINDS[k]) for n, k in fields], [n for n, _ in fields])
    content, odd = B.encode(B.table(batch, np.cumsum([0, *map(len, programs)]), DIMS))
    want = []
    for i, ops in enumerate(programs):
        palette = sorted({op[m] for op in ops for m in ("material", "leaf") if m in op})
        try:
            want.append(P.encode(P.Program(DIMS, ops, palette)))
            assert odd[i] or content[i].as_py() == want[-1]
        except FormatError:
            assert odd[i]
    assert (~odd).sum() > 300 and odd.sum() > 20
    # Bytes that end early, go on, or are changed somewhere are what they are one by one, too.
    spoiled = [b"", b"NC4P", None, *(d[:-1] for d in want[:40]), *(d + b"\0" for d in want[:20])]
    for d in want[:300]:
        at = rng.randrange(len(d))
        spoiled.append(d[:at] + bytes([d[at] ^ 1 << rng.randrange(8)]) + d[at + 1 :])
    ran = 0
    for data in (want, spoiled, want[:0], spoiled[:3]):
        counts, roots, left = B.rooted(pa.array([None, *data], pa.binary()).slice(1), {})
        for d, n, root, skip in zip(data, counts, roots, left):
            assert skip or (n, root) == _drawn(d)
            ran += not skip
    assert ran > 250


def test_a_bare_row_with_a_material_has_it_in_the_palette():
    row = {"op": "translate", "material": 7, "ox": 0, "oy": 0, "oz": 0, "sx": 9, "sy": 9, "sz": 9, "dx": 1, "dy": 1, "dz": 1}
    assert listed_op(row)["material"] == 7
    rows = [{"op": "box", "material": 2, "ox": 1, "oy": 1, "oz": 1, "sx": 1, "sy": 2, "sz": 1}, row]
    fields = [x.rsplit(" ", 1) for x in COMMAND_SCHEMA.split(", ")]
    batch = pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _KINDS[k]) for n, k in fields], [n for n, _ in fields])
    content, odd = B.encode(B.table(batch, np.array([0, 2]), DIMS))
    assert not odd.any() and content[0].as_py() == P.encode(P.Program(DIMS, [listed_op(r) for r in rows], [2, 7]))


def test_batches_may_end_inside_a_scene():
    rows = pa.table({"scene": [5, 5, 5, None, None, 0, 2], "seq": [1, 2, 3, 1, 2, 1, 1]})
    for size in (1, 2, 3, 7):
        found = [(b.column("scene")[int(a)].as_py(), int(z - a)) for b, cuts in codecs._whole(iter(rows.to_batches(size))) for a, z in zip(cuts, cuts[1:])]
        assert found == [(5, 3), (None, 2), (0, 1), (2, 1)]
    assert list(codecs._whole(iter([]))) == []
    with pytest.raises(ValueError, match="together"):
        list(codecs._whole(iter(pa.table({"scene": [1, 2, 1], "seq": [1, 1, 2]}).to_batches())))


@pytest.mark.parametrize("name", ["roundtrip_mixed", "decode_mixed"])
def test_commands_are_shuffled_once_and_scenes_not_gathered(spark, name):
    plan = codecs.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "collect_list" not in plan


def test_assets_that_cannot_be_read_have_no_root(spark):
    box = P.encode(P.Program((8, 8, 8), [{"op": "box", "material": 3, "origin": (1, 1, 1), "size": (2, 2, 2)}], [3]))
    wide = P.encode(P.Program((200, 8, 8), [{"op": "box", "material": 300, "origin": (1, 1, 1), "size": (2, 2, 2)}], [300]))
    empty = P.encode(P.Program((8, 8, 8), [], [3]))
    rows = [("a", bytearray(box)), ("b", bytearray(wide)), ("c", bytearray(empty)), ("d", bytearray(box[:-1])), ("e", None)]
    found = machine.building_roots(spark.createDataFrame(rows, "asset string, content binary")).collect()
    assert sorted(map(tuple, found)) == [("a", *_drawn(box)), ("b", *_drawn(wide))]
