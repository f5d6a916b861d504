"""Builds that run only what changed: each table remembers a digest of its step's version and of all it was made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from parcelweave.sources.datasets import DATASETS
from parcelweave.sources.load import BuildFile, _files, _versions, load_dataset, read_table, write_table

Steps = Mapping[str, tuple[Sequence[str], Callable[..., DataFrame]]]


def digest_of(*parts: str) -> str:
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def file_digest(spark: SparkSession, path: str) -> str:
    """Of the names, lengths and times of change of a file, or of all files of a folder; a path without a file has a digest, too."""
    fs, target = _files(spark, path)
    if not fs.exists(target):
        return digest_of("nothing")
    found, own = fs.listFiles(target, True), []
    while found.hasNext():
        f = found.next()
        own.append(f"{f.getPath().toUri().getPath()} {f.getLen()} {f.getModificationTime()}")
    return digest_of(*sorted(own))


def _remembered(spark: SparkSession, path: str) -> str | None:
    """The digest under which a table's latest version was made; none if that version was written otherwise or its build broke off."""
    fs, note = _files(spark, f"{path}/build.json")
    if not fs.exists(note):
        return None
    (line,) = spark.read.text(f"{path}/build.json", wholetext=True).first()
    told, names = json.loads(line), _versions(spark, path)
    return told["digest"] if names and names[-1] == told["version"] else None


def _remember(spark: SparkSession, path: str, digest: str) -> None:
    fs, note = _files(spark, f"{path}/build.json")
    out = fs.create(note, True)
    try:
        out.write(bytearray(json.dumps({"digest": digest, "version": _versions(spark, path)[-1]}).encode()))
    finally:
        out.close()


def build_needed(spark: SparkSession, target: str, steps: Steps, inputs: Mapping[str, tuple[str, Callable[[], DataFrame]]], versions: Mapping[str, str] | None = None) -> tuple[dict[str, DataFrame], list[str]]:
    """All tables, and the names of the steps that had to run, in their order.

    ``steps`` gives each table's inputs and builder, ``inputs`` each source's path and reader.  A step runs
    if its version (``versions``; one without any is of one version for ever), a source's files or a step
    before it changed, or if its last build did not end.  Its note is written after the table; a table is
    always one version as a whole (``write_table``).
    """
    known = {name: file_digest(spark, path) for name, (path, _) in inputs.items()}
    tables: dict[str, DataFrame] = {}
    waiting, ran = dict(steps), []

    def table(name: str) -> DataFrame:
        if name not in tables:
            tables[name] = inputs[name][1]()
        return tables[name]

    while waiting:
        ready = [name for name, (needs, _) in waiting.items() if set(needs) <= set(known)]
        if not ready:
            raise ValueError(f"inputs missing or circular: {', '.join(sorted(waiting))}")
        for name in ready:
            needs, builder = waiting.pop(name)
            path = f"{target.rstrip('/')}/{name}"
            known[name] = digest_of(name, (versions or {}).get(name, ""), *[f"{n}={known[n]}" for n in needs])
            if _remembered(spark, path) == known[name]:
                tables[name] = read_table(spark, path)
            else:
                tables[name] = write_table(builder(*[table(n) for n in needs]), path)
                _remember(spark, path, known[name])
                ran.append(name)
    return {name: tables[name] for name in steps}, ran


def build_file_needed(spark: SparkSession, plan: BuildFile, folder: str, target: str, builders: Mapping[str, tuple[str, Sequence[str], Callable[..., DataFrame]]], versions: Mapping[str, str] | None = None) -> tuple[dict[str, DataFrame], list[str]]:
    """A build file's steps, as ``BuildFile.build`` takes them, by need."""
    unknown = [d for d in plan.dependencies if d not in DATASETS]
    if unknown:
        raise ValueError(f"unknown datasets: {', '.join(unknown)}")
    inputs = {d: (f"{folder.rstrip('/')}/{DATASETS[d].file}", lambda d=d: load_dataset(spark, folder, d)) for d in plan.dependencies}
    return build_needed(spark, target, {builders[s][0]: builders[s][1:] for s in plan.steps() if s in builders}, inputs, versions)
