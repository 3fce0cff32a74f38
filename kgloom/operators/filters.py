"""Predicates and guards."""

from __future__ import annotations

import fnmatch
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StringType

from ..functions import text as T

#: Names that callers use for a source, and the stored ones.
SOURCE_ALIASES = {"file": "files", "email": "gmail", "mail": "gmail", "notes": "obsidian", "tasks": "omnifocus", "calendar": "google_calendar", "chat": "slack"}
#: First bytes of binary formats.
BINARY_PREFIXES = ("255044462D", "504B0304", "504B0506", "504B0708", "7F454C46", "FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "89504E470D0A1A0A", "FFD8FF", "474946383761", "474946383961", "49492A00", "4D4D002A", "52494646", "1F8B", "425A68", "FD377A585A", "377ABCAF271C", "526172211A07")


def within(since: Column, until: Column, *columns: str) -> Column:
    """Any of the columns in the window, both ends included."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).between(since, until), F.lit(False))
    return out


def optional_equal(column: str, value) -> Column:
    """No condition where there is no value."""
    return F.lit(True) if value is None else F.col(column) == value


def of_source(column: str, source_type: str | None) -> Column:
    return optional_equal(column, SOURCE_ALIASES.get(source_type, source_type))


def in_folders(source_id: Column, folders: list[str]) -> Column:
    """A case-insensitive part of the id is one of the folders; no folders: everything."""
    out = F.lit(not folders)
    for f in folders:
        out = out | F.contains(F.lower(source_id), F.lit(f.lower()))
    return out


def in_dates(value: Column, first, last) -> Column:
    """Dates that cannot be read are kept."""
    day = F.try_to_date(F.substring_index(value, "T", 1), "yyyy-MM-dd")
    return day.isNull() | day.between(F.lit(first), F.lit(last))


def is_open(status: str = "status") -> Column:
    return ~F.coalesce(F.col(status), F.lit("active")).isin("completed", "dropped")


def _glob(pattern: str) -> str:
    return re.sub(r"^\(\?s:(.*)\)\\[zZ]$", r"\1", fnmatch.translate(pattern))


def glob_regex(patterns: list[str]) -> str:
    """One expression for all globs. A pattern with slashes matches adjoining path segments; another one the path, its name or any segment."""
    out = []
    for raw in patterns:
        p = unicodedata.normalize("NFC", raw).strip("/")
        if p and "/" in p:
            out.append("(?:^|/)" + "/".join(_glob(s).replace(".*", "[^/]*") for s in p.split("/")) + "(?:/|$)")
        elif p:
            out.append("^" + _glob(p) + "$|(?:^|/)" + _glob(p).replace(".*", "[^/]*") + "(?:/|$)")
    return "(?s)" + "|".join(out) if out else "(?!)"


@F.pandas_udf(StringType())
def _composed(paths: pd.Series) -> pd.Series:
    return paths.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Paths of plain ASCII stay in the JVM; others are composed (NFC) first."""
    rule = glob_regex(patterns)
    return F.when(path.rlike(r"^[\x00-\x7F]*$"), path.rlike(rule)).otherwise(_composed(path).rlike(rule))


def attachment_decision(mime: Column, size: Column, indexable: list[str], max_mb: int = 25) -> Column:
    fits = T.plain_mime(mime).isin(indexable) & (size <= max_mb * (1 << 20))
    return F.when(fits, "download_and_index").otherwise("metadata_only")


def looks_binary(raw: Column, limit: float = 0.05) -> Column:
    """By first bytes, or more than 5 % of characters that cannot be decoded."""
    head, text = F.hex(F.substring(raw, 1, 8)), F.make_valid_utf8(raw.cast("string"))
    bad = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    out = bad > limit * F.length(text)
    for p in BINARY_PREFIXES:
        out = out | head.startswith(p)
    return out


def image_queue(images: DataFrame, processed: DataFrame, least: int = 1 << 10, most: int = 50 << 20, skip: str | None = None) -> DataFrame:
    """Images to look at: within size bounds, name not skipped, one for each hash, not seen before."""
    kept = images.where(F.col("size").between(least, most))
    if skip:
        kept = kept.where(~T.base_name(F.col("path")).rlike(skip))
    return kept.dropDuplicates(["sha256"]).join(processed.select("sha256"), "sha256", "left_anti")


def retag(queue: DataFrame, exclude: list[str], index_only: list[str]) -> DataFrame:
    """What the patterns in force now say of each queued path."""
    path = F.col("source_id")
    return queue.withColumn("tag", F.when(matches_any(path, exclude), "exclude").when(matches_any(path, index_only), "index_only").otherwise("normal"))


#: Functions that reach out of the data, and table names that read files.
_OUTSIDE = ("reflect", "java_method", "try_reflect", "input_file_name", "read_files")


def _tree(plan) -> str:
    return plan.treeString()


def read_only(spark: SparkSession, statement: str, limit: int = 1000) -> DataFrame:
    """Runs one SELECT or WITH statement, with a limit where it has none; anything else is refused before it runs.

    The parsed plan decides, not the text: commands, writes, functions that call out of the data and tables named by a path (``parquet.`/x```) are refused.
    """
    state = spark._jsparkSession.sessionState()
    plan = state.sqlParser().parsePlan(re.sub(r"[\u00a0\u2000-\u200b\u202f\u3000\ufeff]", " ", statement).strip().rstrip(";"))
    unresolved = _tree(plan)
    names = {m.lower() for m in re.findall(r"'([A-Za-z_][\w]*)\(", unresolved)}
    tables = re.findall(r"UnresolvedRelation \[([^\]]*)\]", unresolved)
    kinds = set(re.findall(r"(?m)^[\s:+|-]*'?([A-Z]\w+)", unresolved))
    by_path = [t for t in tables if re.search(r"[/\\:]|\.", t.split(",")[-1])]
    outside = names & set(_OUTSIDE)
    if "Command" in plan.getClass().getName() or any(k.endswith("Command") or k.startswith(("Insert", "Create", "Drop", "Delete", "Update", "Merge", "Set", "Cache", "Truncate", "Alter", "Load", "Refresh", "ScriptTransformation")) for k in kinds) or outside or by_path:
        raise ValueError("only SELECT statements over tables are run")
    df = spark.sql(statement.strip().rstrip(";"))
    return df if kinds & {"GlobalLimit", "LocalLimit"} and plan.getClass().getSimpleName() in ("GlobalLimit", "LocalLimit") else df.limit(limit)


def safe_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"no identifier: {name!r}")
    return name
