"""Queries over all rows, against brute force."""

import base64
import random

from cubiform.operators import quads
from cubiform.plans import adapters, catalog

SF = "/root/testdata/sf0.001"


def test_lww_state_has_every_scene(spark):
    want = {}
    for r in adapters.commands(spark, SF).orderBy("scene", "seq").collect():
        for x in range(r.ox, r.ox + r.sx):
            for y in range(r.oy, r.oy + r.sy):
                for z in range(r.oz, r.oz + r.sz):
                    want[r.scene, x + 32 * (z + 32 * y)] = 0 if r.flag == "R" else r.material
    got = catalog.QUERIES["lww_state"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted((*k, m) for k, m in want.items() if m)
    assert {r.scene % 10 for r in got} == set(range(10))


def test_faults_of_quads_on_all_axes_and_sides(spark):
    random.seed(8)
    sizes, rest = (14, 10, 14), ((1, 2), (0, 2), (0, 1))
    cells = {(o, x + 14 * (y + 10 * z)) for o in range(3) for x in range(14) for y in range(10) for z in range(14) if o == 0 or random.random() < 0.6}
    rows, want = [], []
    for quad in range(300):
        owner, axis, side = random.randrange(3), quad % 3, quad // 3 % 2
        plane, u, v = random.choice([0, 1, sizes[axis] - 1, sizes[axis]]), random.randrange(12), random.randrange(8)
        u1, v1 = u + random.randint(1, 4), v + random.randint(1, 4)
        rows.append((owner, quad, axis, side, plane, u, u1, v, v1))
        bare = internal = 0
        for a in range(u, u1):
            for b in range(v, v1):
                held = []
                for along in (plane - side, plane - 1 + side):
                    at = [0, 0, 0]
                    at[axis], at[rest[axis][0]], at[rest[axis][1]] = along, a, b
                    held.append(all(0 <= p < n for p, n in zip(at, sizes)) and (owner, at[0] + 14 * (at[1] + 10 * at[2])) in cells)
                bare, internal = bare + (not held[0]), internal + all(held)
        if bare or internal:
            want.append((owner, quad, bare, internal))
    df = spark.createDataFrame(rows, "owner long, quad long, axis long, side long, plane long, u0 long, u1 long, v0 long, v1 long")
    got = quads.faults(df, spark.createDataFrame(sorted(cells), "component long, cell long")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(b == 0 for *_, b, _ in want) and len(want) < 300


def test_whole_texts_are_encoded_and_detected(spark):
    texts = {r.doc_id: r.text for r in adapters.read(spark, SF, "documents").collect()}
    got = {r.doc_id: (r.url, r.bytes) for r in catalog.QUERIES["base64_canonical"](spark, SF).collect()}
    assert got == {i: (base64.urlsafe_b64encode(t.encode()).decode().rstrip("="), len(t.encode())) for i, t in texts.items()}
    sizes = {r.doc_id: r.bytes for r in catalog.QUERIES["detect_format"](spark, SF).collect()}
    assert sizes.keys() == texts.keys() and all(sizes[i] >= len(t.encode()) for i, t in texts.items())
