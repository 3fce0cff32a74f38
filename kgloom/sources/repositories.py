"""Source-control repositories and application bundles on disk as change events.

Folders are listed on the driver, one row for each repository or bundle; what is inside is read by tasks, a repository each. Executors must see the folders.
"""

from __future__ import annotations

import fnmatch
import os
import plistlib
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Most files of a scan, commits of a first scan, bytes of a file, seconds of one call.
MOST_FILES, MOST_COMMITS, MOST_BYTES, SECONDS = 50_000, 200, 100 << 20, 120
EVENT = "source_id string, operation string, repository string, path string, text string, index_only boolean, size long, modified_at string"
COMMIT = "source_id string, operation string, repository string, sha string, text string, author_name string, author_email string, date string, changed_files array<string>"


def matches(path: str, patterns) -> bool:
    """Whether a glob fits the whole path or its last part."""
    return any(fnmatch.fnmatch(path, p) or fnmatch.fnmatch(os.path.basename(path), p) for p in patterns)


def discover(spark: SparkSession, roots: list[str], exclude: tuple[str, ...] = ()) -> DataFrame:
    """(repository, name, head, remote): the roots and folders right under them that are repositories, those excluded by path or name left out; a missing root gives none."""
    found = []
    for root in map(os.path.abspath, roots):
        if os.path.isdir(root):
            inside = [os.path.join(root, c) for c in sorted(os.listdir(root))]
            found += [d for d in (root, *inside) if os.path.isdir(d) and os.path.exists(os.path.join(d, ".git")) and not matches(d, exclude)]
    rows = spark.createDataFrame([(d,) for d in dict.fromkeys(found)], "repository string").repartition(max(1, min(len(found), 10_000)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(d, os.path.basename(d), (git(d, "rev-parse", "--verify", "-q", "HEAD") or "").strip() or None, (git(d, "config", "--get", "remote.origin.url") or "").strip() or None) for d in batch["repository"]]
            yield pd.DataFrame(out, columns=["repository", "name", "head", "remote"])

    return rows.mapInPandas(run, "repository string, name string, head string, remote string")


def git(folder: str, *args: str) -> str | None:
    """Output of a read-only call, null if it fails: an unknown revision, no commit yet."""
    call = ["git", "-c", f"safe.directory={folder}", "-c", "core.quotepath=off", "-C", folder, *args]
    done = subprocess.run(call, capture_output=True, timeout=SECONDS, env={**os.environ, "GIT_OPTIONAL_LOCKS": "0"})
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None


def tree_changes(folder: str, before: str | None, head: str) -> list[tuple[str, str]]:
    """(operation, path) between two revisions; all files of the newer one as created where there is no older one, or it is gone."""
    if before is not None and before == head:
        return []
    told = None if before is None else git(folder, "diff", "--name-status", "--no-renames", "-z", before, head)
    if told is None:
        return [("created", f) for f in (git(folder, "ls-tree", "-r", "-z", "--name-only", head) or "").split("\0") if f]
    parts = told.split("\0")
    kind = {"A": "created", "D": "deleted"}
    return [(kind.get(status[:1], "modified"), path) for status, path in zip(parts[::2], parts[1::2]) if path]


def file_events(repositories: DataFrame, include: tuple[str, ...] = ("*",), exclude: tuple[str, ...] = (), index_only: tuple[str, ...] = (), most_bytes: int = MOST_BYTES) -> DataFrame:
    """Events of files changed since ``before`` (null: all files are created); ``repositories``: repository, head, before.

    Content comes from the head's tree, not from the working copy. Binary, large and index-only files have no text. A first scan stops at 50,000 files, as a guard.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder, head, before in zip(batch["repository"], batch["head"], batch["before"]):
                if not head:
                    continue
                changes = [c for c in tree_changes(folder, before or None, head) if matches(c[1], include) and not matches(c[1], exclude)][:MOST_FILES]
                when = (git(folder, "log", "-1", "--format=%cI", head) or "").strip()
                for start in range(0, len(changes), 100):
                    rows = []
                    for operation, path in changes[start : start + 100]:
                        size, text, listed = None, None, matches(path, index_only)
                        if operation != "deleted":
                            size = int(git(folder, "cat-file", "-s", f"{head}:{path}") or 0)
                            if not listed and size <= most_bytes:
                                text = git(folder, "cat-file", "blob", f"{head}:{path}")
                                text = None if text is None or "\0" in text[:8192] else text
                            listed = text is None
                        rows.append((f"{folder}/{path}", operation, folder, path, text, listed, size, when))
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in EVENT.split(", ")])

    return repositories.select("repository", "head", "before").mapInPandas(run, EVENT)


def commit_events(repositories: DataFrame, indexed: DataFrame | None = None, most: int = MOST_COMMITS) -> DataFrame:
    """Events of the newest commits after ``before`` (null: of the last ones), those already ``indexed`` (source_id) left out; files are those changed against the first parent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder, head, before in zip(batch["repository"], batch["head"], batch["before"]):
                span = head and (f"{before}..{head}" if before else head)
                told = span and git(folder, "log", f"-{most}", "--diff-merges=first-parent", "--name-only", "--no-renames", "--format=%x1e%H%x1f%an%x1f%ae%x1f%at%x1f%B%x1f", span)
                rows = []
                for entry in (told or "").split("\x1e")[1:]:
                    sha, name, mail, at, message, files = entry.split("\x1f")
                    when = pd.Timestamp(int(at), unit="s", tz="UTC").isoformat()
                    rows.append((f"commit:{folder}:{sha}", "created", folder, sha, message.rstrip("\n"), name, mail, when, [f for f in files.split("\n") if f]))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in COMMIT.split(", ")])

    found = repositories.select("repository", "head", "before").mapInPandas(run, COMMIT)
    return found if indexed is None else found.join(indexed.select("source_id"), "source_id", "left_anti")


def since(repositories: DataFrame, cursors: DataFrame) -> DataFrame:
    """Repositories with the head of the last scan as ``before``; those whose head did not move are left out. ``cursors``: repository, head."""
    old = cursors.select("repository", F.col("head").alias("before"))
    return repositories.join(old, "repository", "left").where(F.col("head").isNotNull() & ~F.col("head").eqNullSafe(F.col("before")))


# --- application bundles


def bundle_folders(roots: list[str]) -> list[str]:
    """Bundles in the roots and one level below; links are not followed."""
    out = []
    for root in roots:
        for child in sorted(os.scandir(root), key=lambda e: e.name) if os.path.isdir(root) else ():
            if child.is_dir(follow_symlinks=False):
                inside = [child] if child.name.endswith(".app") else sorted(os.scandir(child.path), key=lambda e: e.name)
                out += [b.path for b in inside if b.name.endswith(".app") and b.is_dir(follow_symlinks=False)]
    return out


def bundles(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, name, bundle_id, version, category, sha256) of bundles whose property list can be read; compare two scans by path and hash with ``snapshots.diff``."""
    found = bundle_folders(roots)
    rows = spark.createDataFrame([(b,) for b in found], "path string").repartition(max(1, min(len(found), 1000)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            out = []
            for path in batch["path"]:
                try:
                    with open(os.path.join(path, "Contents", "Info.plist"), "rb") as f:
                        raw = f.read()
                    told = plistlib.loads(raw)
                except (OSError, ValueError, plistlib.InvalidFileException):
                    continue
                name = told.get("CFBundleDisplayName") or told.get("CFBundleName") or os.path.basename(path).removesuffix(".app")
                out.append((path, name, told.get("CFBundleIdentifier", ""), told.get("CFBundleShortVersionString", ""), told.get("LSApplicationCategoryType", ""), hashlib.sha256(raw).hexdigest()))
            yield pd.DataFrame(out, columns=["path", "name", "bundle_id", "version", "category", "sha256"])

    return rows.mapInPandas(run, "path string, name string, bundle_id string, version string, category string, sha256 string")
