"""Scalar text functions as column expressions, and their driver-side twins where a report needs them."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terminal colours, and the level in front of a build log's line.
ANSI, LOG_PREFIX = r"\x1b\[[0-9;]*m", r"^\[(?:INFO|WARNING|ERROR|DEBUG)\]\s*"


def fill_page(template: Column, page: Column) -> Column:
    return F.replace(template, F.lit("{page}"), page.cast("string"))


def plain_log_line(line: Column) -> Column:
    """Without terminal colours and the level in front."""
    return F.regexp_replace(F.regexp_replace(line, ANSI, ""), LOG_PREFIX, "")


def artifact_key(group: Column, artifact: Column) -> Column:
    return F.concat_ws(":", group, artifact)


def version_or_implicit(version: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(version), F.lit("")), F.lit("(managed/implicit)"))


def markdown_cell(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"\r?\n", " ")


def slug(text: Column) -> Column:
    """Letters and digits joined by hyphens; a hash prefix if none are left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(s != "", s).otherwise(F.concat(F.lit("item-"), F.substring(F.sha1(text), 1, 8)))


def slug_of(text: str) -> str:
    s = re.sub(r"[^a-z0-9]+", "-", text.strip().lower()).strip("-")
    return s or "item-" + hashlib.sha1(text.encode()).hexdigest()[:8]


def id_and_text(item: Column) -> tuple[Column, Column]:
    """The two sides of `ID::text`."""
    parts = F.split(item, "::", 2)
    return F.trim(parts[0]), F.trim(F.get(parts, F.lit(1)))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def is_test_file(path: Column) -> Column:
    """By a test folder in the path, or the name's start or end."""
    low = F.lower(path)
    return low.rlike(r"(^|/)(test|tests|__tests__)(/|$)") | low.rlike(r"(^|/)test_[^/]*$") | low.rlike(r"(_test\.go|tests?\.java|\.(test|spec)\.(js|ts))$")


#: Fixed value: tasks that only build or check.
SAFE_TASK = r"(?i)(^|[-_:])(build|check|compile|format|lint|test|typecheck|verify)([-_:]|$)"


def is_safe_task(name: Column) -> Column:
    return name.rlike(SAFE_TASK)


def make_target(line: Column) -> Column:
    """The target that a build-file line defines, null if it defines none."""
    return F.nullif(F.regexp_extract(line, r"^([A-Za-z0-9][A-Za-z0-9_.\-]*):(?:\s|$)", 1), F.lit(""))


def in_folders(path: Column, names: list[str]) -> Column:
    """Whether a folder of the path has one of these names."""
    quoted = "|".join(re.escape(n) for n in names)
    return path.rlike(f"(^|/)({quoted})/")


#: What the lines of a failed build say that tell its cause, the most telling first.
CAUSES = [
    "No plugin found for prefix 'dependency'", "BUILD FAILURE", "Operation not permitted", "Failed to retrieve plugin descriptor", "Could not transfer metadata", "Failed to create parent directories",
]


def summary_of_errors(log: str, most: int = 8) -> str:
    """A failed build in a line: for each cause its first line, then the lines that follow, telling ones if there are any,
    up to `most`, once each. More causes than that leave a mark."""
    lines = [x for x in (re.sub(LOG_PREFIX, "", re.sub(ANSI, "", line)).rstrip() for line in log.splitlines()) if x]
    telling = [x for x in lines if any(c in x for c in CAUSES)]
    firsts = [next((x for x in telling if c in x), None) for c in CAUSES]
    picked = list(dict.fromkeys(x for x in firsts if x is not None))
    for line in dict.fromkeys(telling or lines):
        if len(picked) >= most:
            break
        if line not in picked:
            picked.append(line)
    return " | ".join(picked[:most] + ["... (truncated)"] * (len(picked) > most))
