"""Chunks of a text are its own: what stands before it in a slice changes nothing."""

import random

import numpy as np

from cubiform.llm import chunk_dedup


def _chunks(texts: list[bytes]) -> list[list[tuple[int, int]]]:
    offsets = np.cumsum([0, *map(len, texts)])
    starts, digests, at = chunk_dedup.chunks(np.frombuffer(b"".join(texts), np.uint8), offsets, chunk_dedup.ChunkRules())
    return [[(int(s - offsets[i]), d.item()) for s, d in zip(starts[at[i] : at[i + 1]], digests[at[i] : at[i + 1]])] for i in range(len(texts))]


def test_chunks_are_the_same_behind_any_text():
    random.seed(5)
    make = lambda n: "".join(random.choices("abcdefghij ", k=n)).encode()
    texts = [make(random.randint(0, 400)) for _ in range(400)]
    alone = [_chunks([t])[0] for t in texts]
    assert sum(len(c) > 1 for c in alone) > 200
    for _ in range(3):
        order = random.sample(range(400), 400)
        assert _chunks([texts[i] for i in order]) == [alone[i] for i in order]
    assert _chunks([b"", texts[0], b"", b"", b"x", texts[1], b""])[1::4] == [alone[0], alone[1]]


def test_exact_copies_of_short_texts_go(spark):
    rows = [(1, "a short text"), (2, "a short text"), (3, "another short text"), (4, "a short text"), (5, ""), (6, "")]
    got = {r.doc_id: r for r in chunk_dedup.dedup_chunks(spark.createDataFrame(rows, "doc_id long, text string"), texts=True).collect()}
    assert {i: r.kept_text for i, r in got.items()} == dict(rows) | {2: "", 4: ""}
    assert [(got[i].n_shared, got[i].n_removed) for i in (1, 2, 3)] == [(12, 0), (12, 12), (0, 0)]
