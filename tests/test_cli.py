"""The command line, end to end."""

import io
import json

import pytest

from cubiform import cli
from cubiform.sources import wire
from tests.test_formats import BUILDINGS, FORGED, TERRAIN

COTTAGE = bytes.fromhex(BUILDINGS["cottage"][0])


def test_task_baseline_verify(tmp_path, capsys):
    asset, task, result = (tmp_path / n for n in ("asset", "task", "result"))
    asset.write_bytes(TERRAIN["row"][0])
    assert cli.main(["task", str(asset), "--out", str(task), "--asset", "row"]) == 0
    assert cli.main(["baseline", str(task), "--out", str(result)]) == 0
    assert cli.main(["verify", str(task), "--result", str(result)]) == 0
    report = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert report["accepted"] and report["candidate_bytes"] == 15 and report["target_root"] == TERRAIN["row"][2]
    result.write_bytes(result.read_bytes()[:-3])
    assert cli.main(["verify", str(task), "--result", str(result)]) == 2


def test_a_larger_candidate_is_no_improvement(tmp_path):
    asset, task, result = (tmp_path / n for n in ("asset", "task", "result"))
    asset.write_bytes(cli.K.LEGACY_TEXT.encode() + wire.to_base64url(COTTAGE).encode())
    assert cli.main(["task", str(asset), "--out", str(task)]) == 0
    cli.main(["baseline", str(task), "--out", str(result)])
    assert cli.main(["verify", str(task), "--result", str(result)]) == 4


def test_inspect_and_audit(spark, tmp_path, capsys):
    folder = tmp_path / "building"
    folder.mkdir()
    for name, v in BUILDINGS.items():
        (folder / name).write_bytes(bytes.fromhex(v[0]))
    assert cli.main(["inspect", str(folder)]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert {r["root"] for r in rows} == {v[3] for v in BUILDINGS.values()}
    assert cli.main(["audit", str(folder)]) == 0
    assert sorted(json.loads(x)["compact_bytes"] for x in capsys.readouterr().out.splitlines()) == [18, 35, 57, 60, 79]


def test_mine_and_resume(spark, tmp_path, capsys):
    asset = tmp_path / "box"
    asset.write_bytes(bytes.fromhex(BUILDINGS["normal"][0]))
    flags = ["--folder", str(tmp_path / "search"), "--islands", "1", "--population", "4", "--generations", "2"]
    assert cli.main(["mine", str(asset), *flags, "--out", str(tmp_path / "best")]) == 0
    first = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert first["generation"] == 2 and first["bytes"] == len((tmp_path / "best").read_bytes()) <= 18
    assert cli.main(["resume", str(asset), *flags[:-1], "3", "--at", "2"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["generation"] == 3


def test_durations():
    assert [cli.seconds(t) for t in ("90", "5m", "250ms", "2h")] == [90, 300, 0.25, 7200]


def test_self_test_benchmark_and_manifest(spark, tmp_path, capsys, monkeypatch):
    assert cli.main(["self-test"]) == 0 and json.loads(capsys.readouterr().out)["ok"]
    for profile, files in (("building", {n: bytes.fromhex(v[0]) for n, v in BUILDINGS.items()}), ("forged_item", {n: bytes.fromhex(v[0]) for n, v in FORGED.items()}), ("terrain_delta", {n: v[0] for n, v in TERRAIN.items()})):
        (tmp_path / "in" / profile).mkdir(parents=True)
        for name, data in files.items():
            (tmp_path / "in" / profile / name).write_bytes(data)
    (tmp_path / "in" / "building" / "bad").write_bytes(b"\1")
    assert cli.main(["benchmark", str(tmp_path / "in")]) == 0
    rows = {json.loads(x)["asset"].rpartition("/")[2]: json.loads(x) for x in capsys.readouterr().out.splitlines()}
    assert rows["bad"]["error_kind"] == "Truncated" and rows["cottage"]["selected"] == cli.K.COMPACT and rows["cottage"]["selected_bytes"] == 57
    assert rows["row"]["selected"] == cli.K.MACHINE and rows["row"]["selected_bytes"] <= 15 and rows["full"]["selected"] == cli.K.FORGED
    assert cli.main(["golden", str(tmp_path / "in"), "--out", str(tmp_path / "made" / "golden.json")]) == 0
    made = json.loads((tmp_path / "made" / "golden.json").read_text())
    assert [v["root"] for v in made["vectors"] if v["profile"] == "terrain_delta"] == [TERRAIN[n][2] for n in sorted(TERRAIN)] and len(made["vectors"]) == 11


def test_standard_input_and_pretty_reports(monkeypatch, capsys):
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(COTTAGE)))
    assert cli.main(["--pretty", "decode", "-", "--profile", "building"]) == 0
    out = capsys.readouterr().out
    assert json.loads(out)["root"] == BUILDINGS["cottage"][3] and out.count("\n") > 3


def test_files_are_written_whole_or_not_at_all(tmp_path, monkeypatch):
    place = tmp_path / "deep" / "file"
    cli.write(str(place), b"one")
    monkeypatch.setattr(cli.os, "replace", lambda *_: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        cli.write(str(place), b"two")
    assert place.read_bytes() == b"one" and len(list(place.parent.iterdir())) == 1


def test_mined_checkpoints_merge(spark, tmp_path, capsys):
    asset = tmp_path / "row"
    asset.write_bytes(TERRAIN["row"][0])
    flags = ["--family", "machine", "--islands", "2", "--population", "4", "--generations", "2", "--epoch", "2"]
    for n in "ab":
        assert cli.main(["mine", str(asset), *flags, "--seed", str(ord(n)), "--folder", str(tmp_path / n), "--checkpoint", str(tmp_path / f"{n}.ckpt")]) == 0
    assert cli.main(["checkpoint", str(tmp_path / "a.ckpt"), "--merge", str(tmp_path / "b.ckpt"), "--out", str(tmp_path / "c.ckpt")]) == 0
    report = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert report["generation"] == 2 and report["islands"] == 2 and report["best_bytes"] <= 15
    assert cli.main(["checkpoint", str(tmp_path / "c.ckpt")]) == 0
