"""A generation of many scenes at once against founders and evolve, scene by scene."""

import dataclasses
import random

import numpy as np
import pytest

from cubiform.operators import islands, search
from cubiform.operators.search import evolve, founders
from cubiform.operators.variation import MUTATIONS, Compact
from cubiform.plans import codecs
from cubiform.sources import programs as P


def _scenes(seed, several, most=9, side=6):
    rng = random.Random(seed)
    for _ in range(several):
        boxes = [[rng.randrange(1, 5), *(rng.randrange(side) for _ in range(3)), *(rng.randrange(1, 5) for _ in range(3))] for _ in range(rng.randrange(1, most))]
        yield boxes + boxes[: rng.randrange(2)]  # some say the same twice


def _arrays(scenes):
    return np.cumsum([0, *map(len, scenes)]), np.array([b for s in scenes for b in s], np.int64)


def _program(boxes):
    return codecs._program([dict(zip(("material", "ox", "oy", "oz", "sx", "sy", "sz"), b)) for b in boxes])


def _one(boxes, config):
    program = _program(boxes)
    family = Compact(P.execute(program))
    people, seen = founders(family, program, config, 0)
    after, fresh = evolve(family, people, set(seen), config, 0, range(1, 2))
    return people[0][0], after[0][0], after[0][1], len(fresh), all(P.execute(P.decode(p[2])).voxels == family.target.voxels for p in after)


@pytest.mark.parametrize("seed,people", [(44, 4), (5, 4), (11, 6), (21, 6), (23, 6), (38, 4), (67, 6), (73, 6), (111, 6)])
def test_many_scenes_at_once_breed_what_each_breeds(seed, people):
    config = dataclasses.replace(codecs._GENERATION, seed=seed, population=people, elites=1 + seed % 2, tournament=2 + seed % 2)
    scenes = [*_scenes(seed, 150), *_scenes(seed, 30, side=28), [[2, 0, 0, 0, 24, 24, 24], [3, 1, 1, 1, 3, 3, 3]]]
    *made, odd = islands.generation(*_arrays(scenes), codecs.DIMS, config, {})
    assert odd.sum() <= 40 and (seed != 44 or not odd.any())
    got = [tuple(int(c[i]) for c in made) for i in np.flatnonzero(~odd)]
    assert got == [_one(scenes[i], config) for i in np.flatnonzero(~odd)]


def test_the_query_breeds_no_usual_scene_by_itself(spark, monkeypatch):
    """The query's own scenes are all bred at once, and the space is empty again after each."""
    rows = codecs.A.commands(spark, "/root/testdata/sf0.001", dealt=True).select("scene", "seq", "material", "ox", "oy", "oz", "sx", "sy", "sz").toArrow().combine_chunks().to_batches()
    monkeypatch.setattr(search, "offspring", lambda *_: pytest.fail("a scene was bred by itself"))
    scratch = {}
    for read, starts in codecs._whole(iter(rows)):
        boxes = np.stack([read.column(c).to_numpy() for c in ("material", "ox", "oy", "oz", "sx", "sy", "sz")], 1)
        first = islands.generation(starts, boxes, codecs.DIMS, codecs._GENERATION, scratch)
        again = islands.generation(starts, boxes, codecs.DIMS, codecs._GENERATION, scratch)
        assert not first[-1].any() and not scratch["space"].any() and all((a == b).all() for a, b in zip(first, again))


def test_unusual_scenes_are_odd():
    usual = [[1, 0, 0, 0, 2, 2, 2]]
    for bad in ([0, 0, 0, 0, 1, 1, 1], [1, -1, 0, 0, 1, 1, 1], [1, 0, 0, 0, 0, 1, 1], [1, 31, 0, 0, 2, 1, 1], [300, 0, 0, 0, 1, 1, 1]):
        assert islands.generation(*_arrays([usual, [*usual, bad], usual]), codecs.DIMS, codecs._GENERATION, {})[-1].tolist() == [False, True, False]
    assert islands.generation(*_arrays([[[1, 0, 0, 0, 32, 32, 32]], usual]), codecs.DIMS, codecs._GENERATION, {})[-1].tolist() == [True, False]
    assert islands.generation(*_arrays([usual * 60, usual]), codecs.DIMS, codecs._GENERATION, {})[-1].tolist() == [True, False]
    assert [len(c) for c in islands.generation(np.array([0]), np.zeros((0, 7), np.int64), codecs.DIMS, codecs._GENERATION, {})] == [0] * 6


@pytest.mark.parametrize("kind", [k for k in MUTATIONS if k in ("gable", "mirror") or k not in islands.APPENDED])
def test_changes_are_those_of_single_programs(kind):
    scenes = list(_scenes(MUTATIONS.index(kind), 120)) + [[[1, 0, 0, 0, 1, 1, 1]]]
    starts, rows = _arrays(scenes)
    n = np.diff(starts)
    ops, palettes = np.zeros((len(n), 2 * n.max() + 4, 12), np.int16), [_program(s).palette for s in scenes]
    of, i = islands._spread(n)
    ops[of, i, 0], ops[of, i, 1:8] = islands._OP["box"], rows
    padded = np.array([p + [127] * (9 - len(p)) for p in palettes])
    draws = islands.Draws(codecs._GENERATION, 0, 9, len(n), 200)
    new, m = islands.mutate(kind, ops, n, draws, np.arange(len(n)), (padded, np.array([len(p) for p in palettes])), codecs.DIMS)
    new, m = islands._distinct(new, m)
    t = islands._table(new, m, codecs.DIMS)
    content, odd = islands.B.encode(t, (np.repeat(np.arange(len(n)), [len(p) for p in palettes]), np.concatenate(palettes)))
    assert not odd.any()
    for k, s in enumerate(scenes):
        rng = islands.ChaCha8.seeded(44, 0, 9)
        one = P.Program(codecs.DIMS, (p := Compact(P.execute(_program(s)))).tidy(p.mutate(_program(s), rng, kind)).ops, palettes[k])
        assert content[k].as_py() == P.encode(one) and len(one.ops) == m[k]


def test_residuals_are_the_smallest_and_are_read_again():
    rng, size, found = random.Random(5), (32, 32, 32), []
    for k in range(400):
        ids = set()
        for _ in range(rng.randrange(6)):
            at, step = rng.randrange(32768), rng.choice((1, 1, 32, 1024))
            ids |= {min(32767, at + step * j) for j in range(rng.randrange(1, 60 if k % 3 else 5))}
        kinds = rng.choice(((0,), (1,), (0, 1, 2), (0, 2)))
        found.append([(i, q, 0 if q == 1 else rng.choice((2, 5, 6))) for i in sorted(ids) for q in [rng.choice(kinds)]])
    palette = [2, 5, 6]
    whose = np.repeat(np.arange(len(found)), [len(f) for f in found])
    ids, kind, index = (np.array([c(p) for f in found for p in f], np.int64) for c in (lambda p: p[0], lambda p: p[1], lambda p: sum(m < p[2] for m in palette)))
    data, lengths, odd = islands.residuals(len(found), whose, ids, kind, index, size)
    ends = np.cumsum(lengths)
    tags = set()
    for k, patches in enumerate(found):
        best = min(P.residuals(size, palette, patches), key=lambda b: (len(b), b[0]))
        assert odd[k] == (best[0] in (4, 5)) and (odd[k] or data[ends[k] - lengths[k] : ends[k]].tobytes() == best)
        tags.add(best[0])
    assert tags >= {0, 1, 2, 6}
    *read, unread = islands.read_residuals(data, lengths, size)
    assert not unread.any() and all((a == b).all() for a, b in zip(read, (whose, ids, kind, np.where(kind == 1, -1, index))))


def test_candidates_may_all_fail():
    ops = np.zeros((1, 4, 12), np.int16)
    ops[0, 0, :8] = islands._OP["box"], 1, 0, 0, 0, 2, 2, 2
    targets = islands.Scenes(ops, np.array([1]), (np.array([[1]]), np.array([1])), codecs.DIMS, np.zeros(islands._RUN * 32768, np.uint8))
    ops[0, 1] = islands._OP["mirror"], 0, 9, 9, 9, 2, 2, 2, 9, 9, 9, 0
    valid, *_ = targets.evaluate(np.array([0]), ops, np.array([2]))
    assert not valid.any() and not targets.odd.any()
    ops[0, 1, 2:5] = ops[0, 1, 8:11] = 0
    valid, length, units, text = targets.evaluate(np.array([0]), ops, np.array([2]))
    program = P.decode(text(0))
    assert valid.all() and len(text(0)) == length[0] and [op["op"] for op in program.ops] == ["box", "mirror"] and P.execute(program).units == units[0]
