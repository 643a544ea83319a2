"""Whole audits put together from the corpus operators: code clones, version governance, repository profiles; and reports."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import corpus


def clone_groups(units: DataFrame, kind: str, threshold: float = 0.9, budget: int | None = 50_000, autojunk: bool = True) -> tuple[DataFrame, DataFrame]:
    """Exact groups and similar groups of units of a kind ("method" or "class"); members of exact groups are out of the second."""
    mine = units.where(F.col("kind") == "method" if kind == "method" else F.col("kind") != "method")
    exact = corpus.exact_groups(mine, "hash_exact", "uid", "line_count", f"{kind}-exact")
    rest = mine.join(corpus.group_members(mine, exact, "hash_exact").select("uid"), "uid", "left_anti")
    similar = corpus.similar_groups(rest, "uid", "generalized", "token_count", "hash_exact", threshold, budget, autojunk)
    return exact, similar


def advice(members: DataFrame, group_col: str = "group_id") -> DataFrame:
    """group, risk (the highest), reasons (in order, once each), same_file, same_package, recommendation."""
    score = F.coalesce(F.when(F.col("risk_level") == "high", 2).when(F.col("risk_level") == "medium", 1), F.lit(0))
    g = members.groupBy(group_col).agg(
        F.max(score).alias("score"), F.array_distinct(F.flatten(F.array_sort(F.collect_list("risk_reasons")))).alias("reasons"),
        (F.count_distinct("file") == 1).alias("same_file"), (F.count_distinct("package") == 1).alias("same_package"),
    )
    text = F.when(F.col("score") == 2, "review by hand before moving").when(F.col("same_file"), "extract a private method").when(F.col("same_package"), "extract a package-level helper").otherwise("extract a shared component")
    return g.select(group_col, F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("score") + 1).alias("risk"), "reasons", "same_file", "same_package", text.alias("recommendation"))


def clone_summary(units: DataFrame, exact: DataFrame) -> DataFrame:
    return units.agg(F.count_if(F.col("kind") != "method").alias("classes"), F.count_if(F.col("kind") == "method").alias("methods"), F.count_distinct("file").alias("files")).crossJoin(exact.agg(F.count(F.lit(1)).alias("exact_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("exact_members")))


def version_audit(entries: DataFrame, min_occurrences: int = 2) -> DataFrame:
    """Conflicts and duplicates of properties, dependencies and plugins: kind, key, occurrences, distinct_values, status, values."""
    out = None
    for kind in ("property", "dependency", "plugin"):
        g = corpus.version_groups(entries.where(F.col("kind") == kind), "key", "value", F.col("module"), min_occurrences).select(F.lit(kind).alias("kind"), "*")
        out = g if out is None else out.unionByName(g)
    return out


def propagation(entries: DataFrame) -> DataFrame:
    """What each module gets through other modules of the tree, with whether it declares it itself."""
    modules = entries.where(F.col("kind") == "module").select("key").distinct()
    declared = entries.where((F.col("kind") == "dependency") & (F.col("section") == "dependencies")).select("module", "key")
    paths = corpus.reachable(declared, modules).select(F.col("consumer").alias("module"), F.col("dependency").alias("key"), "path")
    return corpus.direct_flag(paths, declared)


def audit_gate(groups: DataFrame) -> DataFrame:
    return groups.agg(F.coalesce(F.bool_or(F.col("status") == "conflict"), F.lit(False)).alias("failed"))


def repository_profile(files: DataFrame) -> dict[str, DataFrame]:
    """Counts by extension and top folder, and the test files of a listing."""
    top = F.regexp_extract("path", "^([^/]+)/", 1)
    return {
        "extensions": corpus.top_counts(files.where("extension <> ''"), ["extension"]),
        "folders": corpus.top_counts(files.select(top.alias("folder")).where("folder <> ''"), ["folder"]),
        "tests": files.where("is_test").select("path"),
        "totals": files.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.count_if("is_test").alias("tests")),
    }


def markdown_table(rows: DataFrame, title: str | None = None, most: int = 10_000) -> str:
    """A pipe table of a small result, in the driver. A table that is cut at `most` rows says so in its last line."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    held = rows.limit(most + 1).collect()
    lines = [f"## {title}", ""] if title else []
    lines += ["| " + " | ".join(map(cell, rows.columns)) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in held[:most]]
    if len(held) > most:
        lines += ["", f"There are more than these {most} rows."]
    return "\n".join(lines) + "\n"


def checklist_markdown(title: str, tasks: DataFrame) -> str:
    """Title, progress, gate and table of a checklist."""
    p, g = corpus.progress(tasks).first(), corpus.gate(tasks).first()
    return f"# {title}\n\nProgress: {p.percent if p else 0}%\n\nGate: {g.gate if g and g.gate else 'PENDING'}\n\n" + markdown_table(tasks.orderBy("task_id"))


def json_report(rows: DataFrame) -> str:
    """A pretty JSON array of a small result, non-ASCII text as it is, all rows."""
    return json.dumps([json.loads(x) for x in rows.toJSON().collect()], ensure_ascii=False, indent=2)


def clone_overview(members: DataFrame, advised: DataFrame, group_col: str = "group_id", first: int = 3) -> DataFrame:
    """A row a group: members, the first few locations in order of uid, risk, recommendation, and how to see the rest."""
    g = members.groupBy(group_col).agg(F.count(F.lit(1)).alias("member_count"), F.slice(F.array_sort(F.collect_list("uid")), 1, first).alias("locations"))
    hint = F.when(F.col("member_count") > first, F.concat(F.lit("filter members by group "), F.col(group_col)))
    return g.join(advised.select(group_col, "risk", "recommendation"), group_col).withColumn("hint", hint)


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows with equal keys the first in the order: a map that keeps what it was given first."""
    return corpus.first_per_group(rows, keys, order, 1)


def named(rows: DataFrame, key: str, names: DataFrame, name: str) -> DataFrame:
    """rows with the name that `names` (key, name: one row a key) has for the key; the key itself where it has none."""
    return rows.join(names.select(key, F.col(name).alias("__name")), key, "left").withColumn(name, F.coalesce("__name", F.col(key))).drop("__name")


def path_groups(paths: DataFrame, min_occurrences: int = 2) -> DataFrame:
    """key, occurrences, distinct_values, status and values of dependency paths (key, value, module, scope, direct, path):
    for each value its places in order."""
    place = F.struct("module", "path", "scope", F.when(F.col("direct"), "direct").otherwise("transitive").alias("relationship"))
    by = paths.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(place)).alias("places"))
    groups = by.groupBy("key").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("distinct_values"), F.array_sort(F.collect_list(F.struct("value", "n", "places"))).alias("values"))
    return groups.where(F.col("occurrences") >= min_occurrences).withColumn("status", F.when(F.col("distinct_values") > 1, "conflict").otherwise("duplicate"))


def path_audit(component: DataFrame, resolved: DataFrame, hints: DataFrame, min_occurrences: int = 2) -> DataFrame:
    """kind and path_groups of the four kinds: component, effective, indirect, conflict hints (which count from one on)."""
    kinds = {"component": (component, min_occurrences), "effective": (resolved, min_occurrences), "indirect": (resolved.where(~F.col("direct")), min_occurrences), "hint": (hints, 1)}
    return reduce(DataFrame.unionByName, [path_groups(df, n).select(F.lit(k).alias("kind"), "*") for k, (df, n) in kinds.items()])
