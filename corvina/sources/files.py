"""Files of a work tree or a git branch as a DataFrame (file, text), with ignore rules."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.functions import columns as C


#: Files that one process reads from a branch.
GROUP = 200


def git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True).stdout


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path): tracked files and untracked ones that are not ignored, each once."""
    names = [p for args in (("ls-files", "-z"), ("ls-files", "-z", "--others", "--exclude-standard")) for p in git(root, *args).split("\0") if p]
    return spark.createDataFrame([(p,) for p in dict.fromkeys(names)], "path string")


def diff_lines(spark: SparkSession, root: str, since: str) -> DataFrame:
    """Name-status lines since a commit, for operators.state.name_status."""
    return spark.createDataFrame([(x,) for x in git(root, "diff", "--name-status", "-M", since).splitlines()], "value string")


def branch_files(spark: SparkSession, root: str, branch: str) -> DataFrame:
    """(path, text) of a branch without a checkout: names on the driver, contents on the executors that share the root.

    A task asks one process for GROUP files at a time. Files that are not UTF-8 are left out.
    """
    import pyarrow as pa

    names = [p for p in git(root, "ls-tree", "-r", "-z", "--name-only", branch).split("\0") if p]

    def blobs(paths):
        asked = "".join(f"{branch}:{p}\0" for p in paths).encode()
        data = subprocess.run(["git", "-C", root, "cat-file", "--batch", "-z"], input=asked, capture_output=True, check=True).stdout
        at = 0
        for _ in paths:
            stop = data.index(b"\n", at)
            size = int(data[at:stop].rsplit(b" ", 1)[1])
            yield data[stop + 1 : stop + 1 + size]
            at = stop + 2 + size

    def read(batches):
        for b in batches:
            for lo in range(0, b.num_rows, GROUP):
                paths, kept, texts = b.column(0).slice(lo, GROUP).to_pylist(), [], []
                for p, raw in zip(paths, blobs(paths)):
                    try:
                        texts.append(raw.decode())
                        kept.append(p)
                    except UnicodeDecodeError:
                        continue
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(texts, pa.string())], ["path", "text"])

    return spark.createDataFrame([(p,) for p in names], "path string").mapInArrow(read, "path string, text string")


def work_tree(spark: SparkSession, root: str) -> DataFrame:
    """(file, text) of all files below root that are UTF-8; the rest is skipped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    text = F.try_validate_utf8(F.decode("content", "utf-8")) if hasattr(F, "try_validate_utf8") else F.decode("content", "utf-8")
    rows = raw.select(F.regexp_replace("path", "^file:/*" + re.escape(root.strip("/")) + "/", "").alias("file"), F.when(F.is_valid_utf8(F.col("content").cast("string")), text).alias("text"))
    return rows.where("text IS NOT NULL")


def ignore_regex(pattern: str) -> str | None:
    """A regular expression of one ignore pattern for whole paths, parents included; None if it is no pattern."""
    body = pattern.strip().lstrip("!")
    if not body or body.startswith("#") or body.count("[") != body.count("]"):
        return None
    rooted = "/" in body.rstrip("/")
    folder = body.endswith("/")
    out, i, core = "", 0, body.strip("/")
    while i < len(core):
        if core.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif core.startswith("**", i):
            out, i = out + ".*", i + 2
        elif core[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif core[i] == "?":
            out, i = out + "[^/]", i + 1
        elif core[i] == "[" and "]" in core[i:]:
            stop = core.index("]", i)
            out, i = out + "[" + core[i + 1 : stop].replace("!", "^", 1) + "]", stop + 1
        else:
            out, i = out + re.escape(core[i]), i + 1
    return ("^" if rooted else "(?:^|.*/)") + out + ("/.*$" if folder else "(?:/.*)?$")


def excluded(path: Column, patterns: list[str]) -> Column:
    """The last pattern that matches decides; one with a leading ! takes a path back. Bad patterns are dropped."""
    out = F.lit(False)
    for p in patterns:
        if (rx := ignore_regex(p)) is not None:
            out = F.when(path.rlike(rx), F.lit(not p.strip().startswith("!"))).otherwise(out)
    return out


def indexable(files: DataFrame, patterns: list[str] = ()) -> DataFrame:
    """Files worth indexing, with their language: none excluded, own or generated."""
    path = F.col("file")
    lang = F.coalesce(C.language_of(path, C.PARSED), C.language_of(path, C.RAW))
    return files.withColumn("language", lang).where(F.col("language").isNotNull() & ~excluded(path, list(patterns)) & ~C.own_artifact(path) & ~C.generated(path, F.col("text")))
