"""Corpora kept in the normal form: read again while they have what the tasks need, made anew once where they lack it."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from tessera.sources import corpora


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def snapshots(spark: SparkSession, cache: str) -> list[int]:
    """Numbers of the whole snapshots under ``cache``."""
    files, at = _folder(spark, cache)
    names = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n.removeprefix("snapshot-")) for n in names if n.startswith("snapshot-"))


def publish(spark: SparkSession, corpus: corpora.Corpus, cache: str, tasks: tuple[str, ...] = ()) -> str:
    """Writes a snapshot and gives it its name in one step, when all of it is there; of two at once both are kept."""
    part = f"{cache}/.part-{uuid.uuid4().hex}"
    corpora.write_bundle(corpus, part)
    asked = spark.createDataFrame([(t,) for t in sorted(tasks)], "task string")
    asked.coalesce(1).write.json(f"{part}/asked")
    files, at = _folder(spark, part)
    n = max(snapshots(spark, cache), default=-1) + 1
    while True:
        name = f"{cache}/snapshot-{n}"
        target = spark._jvm.org.apache.hadoop.fs.Path(name)
        # a rename onto a folder that is there would move into it
        if not files.exists(target) and files.rename(at, target):
            return name
        n += 1


def load(spark: SparkSession, name: str, root: str, split: str, cache: str, tasks: tuple[str, ...] = ()) -> corpora.Corpus:
    """The corpus that reader ``name`` gives for ``root`` and ``split``, from its last snapshot under ``cache``.

    Where that lacks a table that one of ``tasks`` needs, the source is read once more and a new snapshot published; readers of
    older ones go on with theirs. If the source has no such table either, that is an error, and the source is not read again
    for this task. Snapshots are never changed; ``prune`` deletes old ones.
    """
    have = snapshots(spark, cache)
    needed = {corpora.TASK_TABLES[t] for t in tasks if t in corpora.TASK_TABLES}
    if have:
        last = f"{cache}/snapshot-{have[-1]}"
        tables = {r.name for r in spark.read.json(f"{last}/metadata").collect()}  # five rows at most
        asked = {r.task for r in spark.read.schema("task string").json(f"{last}/asked").collect()}
        if needed <= tables or needed - tables <= {corpora.TASK_TABLES.get(t) for t in asked}:
            return corpora.read_bundle(spark, last, tasks)
        tasks = tuple({*tasks, *asked})
    made = publish(spark, corpora.load(spark, name, root, split), cache, tasks)
    return corpora.read_bundle(spark, made, tuple(t for t in tasks if corpora.TASK_TABLES.get(t) in needed))


def prune(spark: SparkSession, cache: str, keep: int = 1) -> None:
    """Deletes all but the last ``keep`` snapshots; nothing must read them any more."""
    for n in snapshots(spark, cache)[: -keep or None]:
        files, at = _folder(spark, f"{cache}/snapshot-{n}")
        files.delete(at, True)
