"""Known assets: roots, hashes, sizes and units; round trips; malformed inputs."""

import random

import pytest

from cubiform import constants as K
from cubiform.operators import compress
from cubiform.sources import candidates as C
from cubiform.sources import envelopes as E
from cubiform.sources import forged as G
from cubiform.sources import programs as P
from cubiform.sources import wire

#: name: payload, compact bytes, units, root, encoding hash or None.
BUILDINGS = {
    "normal": ("01080808010101000000070307", 18, 257, "37c31cab8ce82ad1fdd42c4d63819eb95af309431bcba56b0d2565c6f4584c8c", "e5ee90b2759ede4b92e3d206164cc6b57f537b530f574e9c69a702fe29d2a290"),
    "boundary": ("018002108002020102ff010fff01000000020300000000000003aa0100aa01", 35, 7, "43afefa8ff118f3a7c53fd4ff6e949cb18b52bda13b1bcda8478265ba0c1e451", "564fb9072dc1c03db23ee3bd734ad8f4177143e7d1c2b952db94d75fbe817cd4"),
    "cottage": ("012018200701020000001f001f0101040104170700010104011b1707000203040105000700030e0000070408090a0f0b05050201021300040405060601140803", 57, 2581, "5d08001e2f3d0d2fdd560774858c52ed2cf52fbcfd36c2111c07eafa5130e21b", "074e3e122452aac7d092c1bba64b980857b7dfe264afe491fd39e829c80f7132"),
    "variant": ("0124182407010200000023002301010401041b0700010104011f1b07000203040105000700040e0000070408090b130d05050201021700040405060801180803", 60, 3614, "bc5039d7702f720c02d6e5cd821a4cad541ab50cbe2496c6b62fbe2f8eeb1290", None),
    "workshop": ("013018280b01020000002f002701010501052506000101050122250600010105010600061b01012a010600061b0203060106000600050e000007040a080a1b1305050101021d0005050502010318010504050608011c080304050624011c0803", 79, 7672, "460acc2c6fe10be340d24d5b7592586cee8f252437daf5354f7b3528df8c9d7d", None),
}
FORGED = {
    "full": ("f000c0d8000108310518720928b0450081024000", 40, "fe2711b63a103466d52990c45cff5565c893932c1f35df3c9ef927ee4141dd68", "dde47985cec9b7c6aae066798744f8948315b8d1e81f554e5dc8c215fd0e729d"),
    "boundary": ("fffff7fff00108310518720928b06bffc07fc05003ff006007fe0099006007d3001000", 56, "48d0e58ad77c1f5357b06230eee697054e168d9d9a0b2e1d44421343f798e1e5", "a63aca25e3e0259b42ee960a0a13e5d9a0cfdb8f7b35220235b9e7c6889c3fe4"),
    "cavity": ("f00f049fb00108310518720928b04e01420300140001b0509199800ba0e0ef80", 63, "cf1cffa69825515af2d82879d57ffb18c4094fe3f580c2d642b58f79ce3da2ed", "de4b52cdde439000699da4dd6c9e033afc6522323bc2425a2fa87d373f3445e5"),
}


def account(min_y, capacity, cells):
    rows = b"".join((x | z << 4 | y << 8).to_bytes(3, "little") for x, y, z in cells)
    return K.ACCOUNT_MAGIC.encode() + b"\1\0" + len(cells).to_bytes(2, "little") + capacity.to_bytes(2, "little") + min_y.to_bytes(2, "little", signed=True) + bytes(4) + rows.ljust(3 * capacity, b"\0")


TERRAIN = {
    "row": (account(-64, 64, [(x, 12, 3) for x in range(16)]), 15, "089509eb2f1f882d4d20ac4d6e423d1f7be6ad39be5436d486f4a6de79eb1180"),
    "boundary": (account(-256, 64, [(0, 0, 0), (15, 0, 15), (0, 511, 15), (15, 511, 0)]), 24, "c70bd322d27906bfdb9323c49344e29e3cbbd5ce8c3505a6b8ee82fd23ae7342"),
    "cavity": (account(-128, 256, [(x, y, z) for y in range(40, 44) for z in range(3, 11) for x in range(2, 10) if (x + y + z) % 11]), 75, "410c766faca2363e7d11c783d0ee694b8c6878b9d030aff30765089c94e8fd5e"),
}


@pytest.mark.parametrize("name", BUILDINGS)
def test_building(name):
    payload, size, units, root, code = BUILDINGS[name]
    found = P.audit(bytes.fromhex(payload))
    assert (found["compact_bytes"], found["units"], found["root"]) == (size, units, root)
    assert P.execute(P.decode(found["encoding"])).root() == root
    if code:
        assert P.encoding_hash("building", K.LEGACY, bytes.fromhex(payload)) == code
    scene = P.execute(P.read_legacy(bytes.fromhex(payload)))
    assert C.run_building(C.read_building(compress.building(scene))).voxels == scene.voxels


@pytest.mark.parametrize("name", FORGED)
def test_forged(name):
    payload, size, root, code = FORGED[name]
    item = G.read_forged(bytes.fromhex(payload))
    assert item.root() == root and P.encoding_hash("forged_item", K.FORGED, bytes.fromhex(payload)) == code
    best = compress.forged(item)
    assert len(best) <= size and C.read_forge(best)[0].root() == root
    task = E.Task("forged_item", name, K.FORGED, bytes.fromhex(payload))
    report = E.verify(E.read_task(task.to_bytes()), E.Result(task.task_id, best, "forged_item"))
    assert report["exact"] and not report["improved"] and report["mismatches"] == 0


@pytest.mark.parametrize("name", TERRAIN)
def test_terrain(name):
    data, size, root = TERRAIN[name]
    min_y, cells = C.read_account(data)
    assert P.semantic_root("terrain_delta", C.terrain_canonical(min_y, cells)) == root
    best = compress.terrain(min_y, cells)
    assert len(best) <= size and C.run_terrain(C.read_terrain(best))[0] == cells


def test_residual_codecs_hold_one_scene():
    random.seed(4)
    for _ in range(50):
        size = tuple(random.randint(1, 6) for _ in range(3))
        ids = sorted(random.sample(range(size[0] * size[1] * size[2]), random.randint(1, size[0] * size[1] * size[2])))
        patches = [(i, kind := random.randint(0, 2), 0 if kind == 1 else random.choice([3, 9])) for i in ids]
        for data in P.residuals(size, [3, 9], patches):
            r = wire.Bytes(data)
            assert P.read_residual(r, size, [3, 9]) == patches
            r.end()


def random_program(size=(12, 12, 12)):
    ops, m = [], lambda: random.randint(1, 5)
    for _ in range(random.randint(1, 6)):
        o = tuple(random.randint(0, 4) for _ in range(3))
        s = tuple(random.randint(1, 4) for _ in range(3))
        axis = random.randint(0, 2)
        ops.append(random.choice([
            {"op": "box", "material": m(), "origin": o, "size": s}, {"op": "run", "material": m(), "origin": o, "axis": axis, "length": s[0]},
            {"op": "wall", "material": m(), "origin": o, "axis": axis, "u": s[0], "v": s[1], "thickness": s[2]},
            {"op": "extrude", "material": m(), "origin": o, "axis": axis, "u": 2, "v": 2, "depth": s[0], "mask": [1, 0, 1, 1]},
            {"op": "repeat_box", "material": m(), "origin": o, "size": s, "count": 3, "delta": (1, 0, 2)},
            {"op": "gable", "material": m(), "origin": o, "style": random.randint(0, 2), "z_oriented": random.randint(0, 1), "width": s[0] + 1, "depth": s[1] + 1},
            {"op": "fence", "material": m(), "origin": o, "axis": axis % 2, "length": s[0] + 2, "spacing": s[1]},
        ]))
    ops.insert(0, {"op": "box", "material": 1, "origin": (0, 0, 0), "size": (3, 3, 3)})
    ops.append(random.choice([
        {"op": "translate", "source": (0, 0, 0), "size": (3, 3, 3), "delta": (4, 2, 5)}, {"op": "rotate_y", "source": (0, 0, 0), "size": (3, 2, 4), "target": (6, 1, 6), "turns": random.randint(1, 3)},
        {"op": "mirror", "source": (0, 0, 0), "size": (3, 3, 3), "target": (5, 5, 5), "axis": random.randint(0, 2)}, {"op": "repeat_region", "source": (0, 0, 0), "size": (2, 2, 2), "count": 3, "delta": (3, 0, 0)},
        {"op": "clear_box", "origin": (0, 0, 0), "size": (2, 2, 2)},
    ]))
    return P.Program(size, ops, [1, 2, 3, 4, 5])


def test_compact_round_trip():
    random.seed(9)
    for _ in range(100):
        program = random_program()
        scene = P.execute(program)
        back = P.decode(P.encode(program))
        assert back.ops == [{**op} for op in program.ops] and P.execute(back).voxels == scene.voxels
        fixed = P.exactify(P.Program(program.size, program.ops[:2], [1]), scene)
        assert P.execute(P.decode(P.encode(fixed))).voxels == scene.voxels


def test_arbitrary_bytes_end_in_format_errors():
    random.seed(1)
    good = P.audit(bytes.fromhex(BUILDINGS["cottage"][0]))["encoding"]
    for n in range(len(good)):
        with pytest.raises(wire.FormatError):
            P.decode(good[:n])
    for _ in range(300):
        data = bytearray(good)
        data[random.randrange(len(data))] = random.randrange(256)
        for f in (lambda d: P.execute(P.decode(d)), P.read_legacy, G.read_forged, C.read_building, C.read_terrain, C.read_forge, E.read_task):
            try:
                f(bytes(data))
            except wire.FormatError:
                pass


@pytest.mark.parametrize("data,kind", [
    (bytes.fromhex("0108080801") + b"\x63", "UnknownOpcode"), (bytes.fromhex("01000808") + b"\0", "OutOfBounds"), (bytes.fromhex(BUILDINGS["normal"][0]) + b"\0", "TrailingData"),
    (bytes.fromhex(BUILDINGS["normal"][0])[:-1], "Truncated"), (b"\x02", "UnsupportedVersion"),
])
def test_malformed(data, kind):
    with pytest.raises(wire.FormatError) as e:
        P.read_legacy(data)
    assert e.value.kind == kind


def test_varint_is_canonical():
    for v in (0, 1, 127, 128, 16383, 16384, 2**32 - 1):
        r = wire.Bytes(wire.varint(v))
        assert r.varint() == v
    with pytest.raises(wire.FormatError) as e:
        wire.Bytes(b"\x80\x00").varint()
    assert e.value.kind == "NonCanonical"


def test_limits():
    with pytest.raises(wire.FormatError) as e:
        P.execute(P.Program((8, 8, 8), [{"op": "box", "material": 1, "origin": (0, 0, 0), "size": (2, 1, 1)}]), {"max_writes": 1})
    assert e.value.kind == "ResourceLimit"


def test_task_and_result():
    data, _, root = TERRAIN["row"]
    task = E.Task("terrain_delta", "asset", K.ACCOUNT, data, network=("net", 7, None))
    again = E.read_task(task.to_bytes())
    assert again.task_id == task.task_id and again.root == root
    min_y, cells = C.read_account(data)
    result = E.Result(task.task_id, compress.terrain(min_y, cells), "terrain_delta", (b"me", b"sig"), ("own", 3, 4, 5, 1))
    back = E.read_result(result.to_bytes(), "terrain_delta")
    report = E.verify(again, back)
    assert report["accepted"] and report["saved_bytes"] == 208 - len(result.candidate) and back.result_id == E.Result(task.task_id, result.candidate, "terrain_delta", (b"me", b"sig")).result_id
    wrong = E.Result(task.task_id, compress.terrain(min_y, cells | {0}), "terrain_delta")
    assert E.verify(task, wrong)["mismatches"] == 1 and not E.verify(task, wrong)["exact"]
    with pytest.raises(wire.FormatError):
        E.read_task(task.to_bytes()[:-1] + b"\2")


def test_box_and_run_differ_in_bytes_only():
    a = C.TerrainProgram(0, [{"op": "delete_run", "start": 0, "length": 4}])
    b = C.TerrainProgram(0, [{"op": "delete_box", "origin": (0, 0, 0), "size": (4, 1, 1)}])
    assert C.run_terrain(a)[0] == C.run_terrain(b)[0] and C.write_terrain(a) != C.write_terrain(b)
