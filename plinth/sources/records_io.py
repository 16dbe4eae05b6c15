"""Record files: tolerant JSON lines in, splits and statistics out."""

from __future__ import annotations

import json
import os
import re
import subprocess
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import SCHEMA, gated, normalised
from ..session import Scratch


def read_records(spark: SparkSession, path: str, gate: bool = True) -> DataFrame:
    """Records of JSON lines; blank and broken lines are skipped; ``gate`` keeps those that pass quality control."""
    rows = spark.read.schema(f"{SCHEMA}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    rows = normalised(rows.where("_corrupt_record is null and input_dsl is not null").drop("_corrupt_record"))
    return gated(rows) if gate else rows


def write_splits(records: DataFrame, out: str) -> DataFrame:
    """One folder of JSON lines for each split; gives the counts by split, language and label."""
    records.write.mode("overwrite").partitionBy("split").json(out)
    return records.groupBy("split", "language", "label").agg(F.count("*").alias("records"))


def package(folder: str, target: str) -> str:
    """A zip of a local folder of written splits."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for top, _, names in os.walk(folder):
            for name in sorted(names):
                if not name.startswith((".", "_")):
                    archive.write(os.path.join(top, name), os.path.relpath(os.path.join(top, name), folder))
    return target


def advisories(spark: SparkSession, path: str) -> DataFrame:
    """``(package, id, summary, commit)`` of advisory JSON lines ``{package, id, summary, references}``."""
    from ..functions.scalars import advisory_commit

    rows = spark.read.schema("package string, id string, summary string, references array<string>").json(path)
    return rows.withColumn("commit", advisory_commit(F.array_join("references", " "))).drop("references")


def git(repo: str, *args: str) -> str:
    """Output of a git command, empty where it fails."""
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, timeout=60, check=False)
    return done.stdout if done.returncode == 0 else ""


def _texts(repo: str, names: list[str]) -> Iterator[str]:
    """The text of each ``commit:path``, empty where there is none, through one git process."""
    with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as run:
        for name in names:
            run.stdin.write(name.encode() + b"\n")
            run.stdin.flush()
            head = run.stdout.readline().split()
            if len(head) == 3 and head[2].isdigit():
                text = run.stdout.read(int(head[2]))
                run.stdout.read(1)
                yield text.decode("utf-8", "replace") if head[1] == b"blob" else ""
            else:
                yield ""
        run.stdin.close()


def history(spark: SparkSession, repo: str, most: int = 150, batch: int = 500) -> tuple[DataFrame, DataFrame]:
    """``commits(hash, subject, body, ord)`` and ``commit_files(hash, file_path, before, after)`` of a local repository.

    Commits that a revert names are harvested too, however old. Texts go to the shared folder ``batch`` files at a
    time, so the driver never holds a history's texts.
    """
    form = "--format=%x1e%H%x1f%s%x1f%b%x1f"
    told = git(repo, "log", "--no-merges", "-n", str(most), "--name-only", form)
    named = sorted({m for m in re.findall(r"(?i)revert(?:s|ing) commit\s+([0-9a-f]{7,40})", told)})
    older = [h for h in named if git(repo, "cat-file", "-t", h).strip() == "commit"]
    told += git(repo, "show", "--name-only", form, *older) if older else ""
    commits, pairs = {}, []
    for entry in told.split("\x1e")[1:]:
        commit, subject, body, paths = entry.split("\x1f", 3)
        if commit not in commits:
            commits[commit] = (commit, subject, body, len(commits))
            pairs += [(commit, p) for p in paths.splitlines() if p.strip()]
    scratch = Scratch(spark, "history")
    schema = "hash string, file_path string, before string, after string"
    path = f"{scratch.root}/files"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    for at in range(0, len(pairs), batch):
        part = pairs[at : at + batch]
        texts = list(_texts(repo, [x for c, p in part for x in (f"{c}~1:{p}", f"{c}:{p}")]))
        spark.createDataFrame([(c, p, texts[2 * i], texts[2 * i + 1]) for i, (c, p) in enumerate(part)], schema).write.mode("append").parquet(path)
    return spark.createDataFrame(list(commits.values()), "hash string, subject string, body string, ord int"), spark.read.schema(schema).parquet(path)


def dirty(repo: str) -> list[tuple[str, str]]:
    """``(path, staged text)`` of files whose working copy differs from what is staged or committed."""
    return [(n, git(repo, "show", f":{n}")) for n in git(repo, "diff", "--name-only").splitlines()]


def checkout(source: str, folder: str, name: str, depth: int = 250, offline: bool = False) -> str | None:
    """The folder of a repository's copy: what is there already, else a shallow clone; None where neither can be had."""
    target = os.path.join(folder, name)
    if os.path.isdir(os.path.join(target, ".git")):
        return target
    if offline:
        return None
    done = subprocess.run(["git", "clone", "--quiet", "--depth", str(depth), source, target], capture_output=True, timeout=600, check=False)
    return target if done.returncode == 0 else None


def staged(repo: str) -> list[tuple[str, str, str]]:
    """``(path, staged text, committed text)`` of staged files; what is staged wins over the working copy."""
    names = git(repo, "diff", "--cached", "--name-only", "--diff-filter=ACMR").splitlines()
    return [(n, git(repo, "show", f":{n}"), git(repo, "show", f"HEAD:{n}")) for n in names]


def report_json(rows: DataFrame, most: int = 1000) -> str:
    """A small result as JSON text; a report, so it is limited."""
    return json.dumps([r.asDict(recursive=True) for r in rows.limit(most).collect()], default=str, indent=2)
