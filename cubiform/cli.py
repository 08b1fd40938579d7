"""A thin command line: spark-submit cubiform/cli.py COMMAND ...; reports are JSON, a line each or, with --pretty, indented.

inspect, audit, encode, benchmark and golden take folders of assets; the others take files, or - for what
stands on the standard input. Files are written whole or not at all.
"""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from cubiform import constants as K  # noqa: E402
from cubiform.operators import corpus, search, variation  # noqa: E402
from cubiform.sources import assets, checkpoints, envelopes, programs, wire  # noqa: E402

#: Exit codes by kind of failure; any other kind is 2.
EXIT = {"ResourceLimit": 3, "ArithmeticOverflow": 3, "HashMismatch": 4, "SemanticMismatch": 4, "NotImproved": 4}


def seconds(text: str) -> float:
    """90, 90s, 5m or 2h."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)(ms|s|m|h)?", text)
    if not m:
        raise argparse.ArgumentTypeError(f"not a duration: {text}")
    return float(m[1]) * {"ms": 0.001, "s": 1, "m": 60, "h": 3600}[m[2] or "s"]


def session() -> SparkSession:
    return SparkSession.builder.appName("cubiform").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def emit(df: DataFrame, out: str | None) -> None:
    """A report table: to a folder of JSON, or row by row to the terminal."""
    if out:
        df.write.mode("errorifexists").json(out)
    else:
        for row in df.toJSON().toLocalIterator():
            print(row)


def read(path: str) -> bytes:
    return sys.stdin.buffer.read() if path == "-" else Path(path).read_bytes()


def write(path: str, data: bytes) -> None:
    """A file, or nothing: written beside its place, then moved there."""
    place = Path(path)
    place.parent.mkdir(parents=True, exist_ok=True)
    handle, beside = tempfile.mkstemp(dir=place.parent)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, place)
    except BaseException:
        os.unlink(beside)
        raise


def said(report: dict, pretty: bool = False) -> str:
    return json.dumps(report, indent=2 if pretty else None)


def run(args: argparse.Namespace) -> dict | None:
    if args.command == "self-test":
        return corpus.self_test()
    if args.command in ("inspect", "audit", "encode"):
        found = assets.files(session(), args.path)
        if args.command == "inspect":
            emit(assets.decoded(found), args.out)
        else:
            table = assets.audited(found)
            emit(table.drop("encoding") if args.command == "audit" else table, args.out)
        return None
    if args.command == "benchmark":
        emit(corpus.benchmark(assets.files(session(), args.path)), args.out)
        return None
    if args.command == "golden":
        report = corpus.golden(corpus.benchmark(assets.files(session(), args.path)))
        write(args.out, said(report, True).encode() + b"\n")
        return {"golden": args.out, "vectors": len(report["vectors"])}
    data = read(args.path)
    if args.command == "task":
        made = envelopes.Task(args.profile or envelopes.import_asset(data).profile, args.asset, wire.detect(data) if wire.detect(data) != "unknown" else K.LEGACY, data).to_bytes()
        write(args.out, made)
        return {"task": args.out, "bytes": len(made)}
    if args.command == "baseline":
        task = envelopes.read_task(data)
        result = envelopes.Result(task.task_id, corpus.smallest(task.incumbent, task.profile), task.profile, None, ("baseline", 1, 0, 0, 1))
        write(args.out, result.to_bytes())
        return envelopes.verify(task, result) | {"output": args.out}
    if args.command == "verify":
        task = envelopes.read_task(data)
        return envelopes.verify_improvement(task, envelopes.read_result(read(args.result), task.profile))
    if args.command == "decode":
        target = envelopes.import_asset(data, args.profile)
        return {"profile": target.profile, "root": target.root, "facts": len(target.facts)}
    if args.command == "checkpoint":
        if data.startswith(checkpoints.COMPACT_LINE):
            c, other = checkpoints.read_compact(data), args.merge and checkpoints.read_compact(read(args.merge))
            c, put = checkpoints.migrate_compact(c, other) if other else c, checkpoints.write_compact
            best, state = c["state"]["best"]["encoding"], c["state"]
        else:
            c, other = checkpoints.read_machine(data), args.merge and checkpoints.read_machine(read(args.merge))
            c, put = checkpoints.migrate_machine(c, other) if other else c, checkpoints.write_machine
            best, state = c["bestEncoding"], c
        if args.out:
            write(args.out, put(c))
        return {"generation": state["generation"], "attempts": state["attempts"], "islands": len(state["islands"]), "best_bytes": len(best)}
    if args.command in ("mine", "resume"):
        return mine(args, data)
    raise AssertionError(args.command)


def mine(args: argparse.Namespace, data: bytes) -> dict:
    """Epoch after epoch, until the generations or the time are used up."""
    target = envelopes.import_asset(data, args.profile or ("building" if args.family == "compact" else None))
    if args.family == "machine":
        family = variation.machine(target, data)
        seed = family.read(corpus.smallest(data, target.profile))
    else:
        program = assets.program_of(data)
        family = variation.Compact(programs.execute(program))
        seed = programs.Program(program.size, program.ops, program.palette)
    config = search.SearchConfig(
        seed=args.seed, islands=args.islands, population=args.population, elites=max(1, args.population // 16), tournament=min(3, args.population), shard=args.shard, survivors=args.survivors, epoch=args.epoch
    )
    one = search.Search(session(), args.folder, family, config)
    began, at = time.time(), args.at
    if args.command == "mine":
        one.start(seed)
        at = 0
    else:
        one.resume(at, at)
    for first, last in one.epochs(at, args.generations):
        if args.time_limit is not None and time.time() - began >= args.time_limit:
            break
        one.run(last, first - 1)
        at = last
    best = one.population(at).orderBy("bytes", "units", "encoding").first()
    if args.out:
        write(args.out, bytes(best.encoding))
    if args.checkpoint:
        write(args.checkpoint, checkpoint_of(one, args, data, at))
    took = time.time() - began
    return {
        "generation": at, "attempts": config.attempts(at), "bytes": best.bytes, "units": best.units, "root": target.root, "seconds": round(took, 1), "attempts_per_second": round(config.attempts(at) / max(took, 1e-9), 1)
    }


def checkpoint_of(one: search.Search, args: argparse.Namespace, data: bytes, at: int) -> bytes:
    """The stored search as one file; its islands are bounded by the configuration."""
    config, people = one.config, {}
    for r in one.population(at).orderBy("island", "bytes", "units", "encoding").collect():
        people.setdefault(r.island, []).append(bytes(r.encoding))
    islands = [people[i] for i in sorted(people)]
    best = min((e for p in islands for e in p), key=lambda e: (len(e), e))
    plain = {
        "seed": config.seed, "threads": 1, "islands": config.islands, "population": config.population, "generations": args.generations, "epochGenerations": config.epoch, "eliteCount": config.elites,
        "tournamentSize": config.tournament, "maxAttempts": None, "timeLimitMs": None, "memoryLimitBytes": 1 << 30, "shardIndex": config.shard, "shardCount": config.shard + 1,
    }
    form = wire.detect(data) if wire.detect(data) != "unknown" else {"building": K.LEGACY, "forged_item": K.FORGED}[one.family.profile]
    if args.family == "machine":
        return checkpoints.write_machine(checkpoints.machine(envelopes.Task(one.family.profile, args.asset, form, data), plain, at, config.attempts(at), best, islands))
    return checkpoints.write_compact(checkpoints.compact(data, form, plain, at, config.attempts(at), best, islands, [[] for _ in islands]))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__)
    top.add_argument("--pretty", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("inspect", "audit", "encode", "benchmark", "golden", "task", "baseline", "verify", "decode", "checkpoint", "mine", "resume", "self-test"):
        p = sub.add_parser(name)
        if name == "self-test":
            continue
        p.add_argument("path")
        p.add_argument("--out", required=name in ("golden", "task", "baseline"))
        p.add_argument("--profile", choices=K.PROFILES)
        if name in ("task", "mine", "resume"):
            p.add_argument("--asset", default="asset")
        if name == "verify":
            p.add_argument("--result", required=True)
        if name == "checkpoint":
            p.add_argument("--merge")
        if name in ("mine", "resume"):
            for flag, default in (("seed", 44), ("islands", 4), ("population", 16), ("generations", 20), ("shard", 0), ("survivors", 0), ("at", 0), ("epoch", 5)):
                p.add_argument(f"--{flag}", type=int, default=default)
            p.add_argument("--family", choices=("compact", "machine"), default="compact")
            p.add_argument("--folder", required=True)
            p.add_argument("--checkpoint")
            p.add_argument("--time-limit", type=seconds)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        report = run(args)
    except wire.FormatError as e:
        print(json.dumps({"error": e.kind, "code": e.code}), file=sys.stderr)
        return EXIT.get(e.kind, 2)
    if report is not None:
        print(said(report, args.pretty))
    return 0


if __name__ == "__main__":
    sys.exit(main())
