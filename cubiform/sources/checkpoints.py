"""Checkpoints of searches as files: a line that names the kind, then one JSON value.

The machine's kind belongs to a task, the compact kind carries its source. Hashes and encodings are
arrays of numbers, names are in camel case. What is read is checked: hashes, versions, islands, and
that every encoding still means the target.
"""

from __future__ import annotations

import copy
import json

from .. import constants as K
from . import envelopes, programs
from .wire import FormatError

#: Fixed values of the two kinds.
MACHINE_LINE, COMPACT_LINE = b"NCPC1\n", b"NC4S1\n"
MACHINE_VERSIONS = {"checkpointVersion": 1, "searchEngineVersion": 1, "protocolVersion": 1, "vmVersion": 1, "costModelVersion": 1}
COMPACT_VERSION = 2
#: What the first version of the compact kind lacks.
EVALUATOR = {"kind": "cpu", "cudaDevice": 0, "gpuBatchSize": 2048, "gpuSurvivorsPerIsland": 8}


def _numbers(data: bytes) -> list[int]:
    return list(data)


def _read(data: bytes, line: bytes) -> dict:
    if not data.startswith(line):
        raise FormatError("InvalidEncoding", "checkpoint-magic")
    try:
        found = json.loads(data[len(line) :])
    except ValueError:
        raise FormatError("InvalidEncoding", "checkpoint-json") from None
    if not isinstance(found, dict):
        raise FormatError("InvalidEncoding", "checkpoint-json")
    return found


def _write(line: bytes, value: dict) -> bytes:
    return line + json.dumps(value, separators=(",", ":")).encode()


def _candidate(encoding: bytes, profile: str, form: str, root: str) -> dict:
    return {"encoding": _numbers(encoding), "encodingHash": _numbers(bytes.fromhex(programs.encoding_hash(profile, form, encoding))), "semanticRoot": _numbers(bytes.fromhex(root)), "exact": True}


def _islands(islands: list[list[bytes]], generation: int, made) -> list[dict]:
    return [
        {"index": i, "generation": generation, "rngGeneration": generation, "strategy": "genetic" if i % 2 == 0 else "random", "population": [made(e) for e in people]}
        for i, people in enumerate(islands)
    ]


def _whole(islands: list, config: dict, generation: int) -> bool:
    """Whether all islands are there once, full, and at one generation."""
    return (
        len(islands) == config["islands"] == len({i["index"] for i in islands})
        and all(len(i["population"]) == config["population"] and i["generation"] == i["rngGeneration"] == generation for i in islands)
    )


# ---- the machine's kind --------------------------------------------------------------------


def machine(task: envelopes.Task, config: dict, generation: int, attempts: int, best: bytes, islands: list[list[bytes]] = ()) -> dict:
    """A checkpoint of a search for a task; islands are lists of encodings, best first."""
    root = task.root or task.target().root
    made = lambda e: _candidate(e, task.profile, K.MACHINE, root)
    return {
        **MACHINE_VERSIONS, "taskId": _numbers(task.task_id), "semanticRoot": _numbers(bytes.fromhex(root)), "taskBytes": _numbers(task.to_bytes()), "config": config, "generation": generation,
        "attempts": attempts, "bestEncoding": _numbers(best), "bestEncodingHash": made(best)["encodingHash"], "islands": _islands(islands, generation, made),
    }


def write_machine(checkpoint: dict) -> bytes:
    check_machine(checkpoint)
    return _write(MACHINE_LINE, checkpoint)


def read_machine(data: bytes) -> dict:
    found = {"islands": [], **_read(data, MACHINE_LINE)}
    check_machine(found)
    return found


def check_machine(c: dict) -> None:
    """Versions, the task, the best candidate and the islands, each encoding replayed."""
    try:
        if any(c[k] != v for k, v in MACHINE_VERSIONS.items()):
            raise FormatError("UnsupportedVersion", "checkpoint")
        task = envelopes.read_task(bytes(c["taskBytes"]))
        if bytes(c["taskId"]) != task.task_id or bytes(c["semanticRoot"]).hex() != task.root:
            raise FormatError("HashMismatch", "checkpoint-task")
        if c["islands"] and not _whole(c["islands"], c["config"], c["generation"]):
            raise FormatError("InvalidEncoding", "checkpoint-islands")
        every = [(bytes(c["bestEncoding"]), bytes(c["bestEncodingHash"]))] + [(bytes(p["encoding"]), bytes(p["encodingHash"])) for i in c["islands"] for p in i["population"]]
    except (KeyError, TypeError, ValueError) as e:
        if isinstance(e, FormatError):
            raise
        raise FormatError("InvalidEncoding", "checkpoint-json") from None
    target = task.target()
    for encoding, stated in dict(every).items():
        if programs.encoding_hash(task.profile, K.MACHINE, encoding) != stated.hex():
            raise FormatError("HashMismatch", "checkpoint-candidate")
        if envelopes.mismatches(target, envelopes.import_candidate(encoding, task.profile, task.limits)):
            raise FormatError("HashMismatch", "checkpoint-replay")


# ---- the compact kind ----------------------------------------------------------------------


def compact(source: bytes, form: str, config: dict, generation: int, attempts: int, best: bytes, islands: list[list[bytes]], seen: list[list[bytes]]) -> dict:
    """A checkpoint of a search from a building asset; seen has the hashes that each island knows."""
    root = envelopes.import_asset(source, "building").root
    made = lambda e: _candidate(e, "building", K.COMPACT, root)
    listed = _islands(islands, generation, made)
    for island, known in zip(listed, seen):
        hashes = {bytes(p["encodingHash"]) for p in island["population"]} | set(known)
        island |= {"attempts": attempts // max(1, len(islands)), "seen": [_numbers(h) for h in sorted(hashes)]}
    state = {
        "searchVersion": COMPACT_VERSION, "imported": {"profile": "building", "format": form, "incumbentEncoding": _numbers(source)}, "semanticRoot": _numbers(bytes.fromhex(root)),
        "sourceEncodingHash": _numbers(bytes.fromhex(programs.encoding_hash("building", form, source))), "sourceBytes": len(source), "config": config, "evaluator": dict(EVALUATOR),
        "generation": generation, "attempts": attempts, "best": made(best), "islands": listed,
    }
    return {"state": state}


def write_compact(checkpoint: dict) -> bytes:
    check_compact(checkpoint)
    return _write(COMPACT_LINE, checkpoint)


def read_compact(data: bytes) -> dict:
    """The first version becomes the second."""
    found = _read(data, COMPACT_LINE)
    state = found.get("state")
    if isinstance(state, dict) and state.get("searchVersion") == 1:
        found = {"state": {**state, "searchVersion": COMPACT_VERSION, "evaluator": dict(EVALUATOR)}}
    check_compact(found)
    return found


def _replayed(encoding: bytes, root: str) -> tuple[int, int, bytes]:
    scene = programs.execute(programs.decode(encoding))
    if scene.root() != root:
        raise FormatError("HashMismatch", "checkpoint-replay")
    return len(encoding), scene.units, encoding


def check_compact(checkpoint: dict) -> None:
    try:
        s = checkpoint["state"]
        source, form, root = bytes(s["imported"]["incumbentEncoding"]), s["imported"]["format"], bytes(s["semanticRoot"]).hex()
        stated = (s["searchVersion"], s["imported"]["profile"], s["sourceBytes"], bytes(s["sourceEncodingHash"]).hex(), s["best"]["exact"])
        if stated != (COMPACT_VERSION, "building", len(source), programs.encoding_hash("building", form, source), True):
            raise FormatError("HashMismatch", "checkpoint-state")
        if envelopes.import_asset(source, "building").root != root:
            raise FormatError("HashMismatch", "checkpoint-source")
        if not 0 < s["evaluator"]["gpuBatchSize"] <= 65_535 or not 0 < s["evaluator"]["gpuSurvivorsPerIsland"] <= 16_384:
            raise FormatError("ResourceLimit", "evaluator")
        if not _whole(s["islands"], s["config"], s["generation"]) or any(not {bytes(p["encodingHash"]) for p in i["population"]} <= {bytes(h) for h in i["seen"]} for i in s["islands"]):
            raise FormatError("InvalidEncoding", "checkpoint-islands")
        every = [s["best"], *(p for i in s["islands"] for p in i["population"])]
        every = {bytes(p["encoding"]): bytes(p["encodingHash"]) for p in every}
    except (KeyError, TypeError, ValueError) as e:
        if isinstance(e, FormatError):
            raise
        raise FormatError("InvalidEncoding", "checkpoint-json") from None
    for encoding, stated_hash in every.items():
        if programs.encoding_hash("building", K.COMPACT, encoding) != stated_hash.hex():
            raise FormatError("HashMismatch", "checkpoint-candidate")
        _replayed(encoding, root)


# ---- migration -----------------------------------------------------------------------------


def _taken_in(islands: list[dict], migrant: dict, order) -> None:
    """The migrant takes the last place of each island that hasn't its encoding."""
    for island in islands:
        people = island["population"]
        if people and all(p["encoding"] != migrant["encoding"] for p in people):
            people[-1] = copy.deepcopy(migrant)
            people.sort(key=order)
            if "seen" in island:
                island["seen"] = sorted({*map(tuple, island["seen"]), tuple(migrant["encodingHash"])})
                island["seen"] = [list(h) for h in island["seen"]]


def migrate_machine(local: dict, external: dict) -> dict:
    """The local checkpoint with the best candidate of another one of the same task."""
    check_machine(local)
    check_machine(external)
    if local["taskId"] != external["taskId"]:
        raise FormatError("HashMismatch", "checkpoint-migration")
    task = envelopes.read_task(bytes(local["taskBytes"]))

    def order(p: dict) -> tuple:
        encoding = bytes(p["encoding"])
        return len(encoding), envelopes.import_candidate(encoding, task.profile, task.limits).units, encoding

    merged = copy.deepcopy(local)
    migrant = _candidate(bytes(external["bestEncoding"]), task.profile, K.MACHINE, task.root)
    if order(migrant) < order({"encoding": local["bestEncoding"]}):
        merged |= {"bestEncoding": migrant["encoding"], "bestEncodingHash": migrant["encodingHash"]}
    _taken_in(merged["islands"], migrant, order)
    check_machine(merged)
    return merged


def migrate_compact(local: dict, external: dict) -> dict:
    """The local checkpoint with the best candidate of another one of the same target."""
    check_compact(local)
    check_compact(external)
    if local["state"]["semanticRoot"] != external["state"]["semanticRoot"]:
        raise FormatError("HashMismatch", "checkpoint-migration")
    root = bytes(local["state"]["semanticRoot"]).hex()
    order = lambda p: _replayed(bytes(p["encoding"]), root)
    merged = copy.deepcopy(local)
    migrant = external["state"]["best"]
    if order(migrant) < order(merged["state"]["best"]):
        merged["state"]["best"] = copy.deepcopy(migrant)
    _taken_in(merged["state"]["islands"], migrant, order)
    check_compact(merged)
    return merged
