"""Which copy to keep, what to do with the others, and how sure that is."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirrorlake.functions import paths
from mirrorlake.options import ScanOptions

VERDICTS = "map<string,struct<action:string,reason:string>>"


def _any(*words: str) -> str:
    return "(" + "|".join(words) + ")"


JUNK = "(?i)" + _any(*(rf"\b{w}\b" for w in ("conflict", "conflicted", "copia", "copy", "duplicate", "kopie", "old")), r"\([0-9]+\)", "_[0-9]{1,2}$", "~$")
POOR = _any("desktop", "downloads?", "import", "inbox", "neuer ordner", "new folder", "recovered", "te?mp", "to.?sort", "unsorted")
RICH = _any("archive", "documents?", "dokumente", "foto", "library", "media", "musi[ck]", "photo", "projects?", "shared", "video")
GUARDED = _any("archiv", "backup", r"[.]history", "snapshot", "time.?machine", "versions?")


def keep_score(path: Column, mtime: Column, size: Column, now: float) -> Column:
    """Higher is better to keep: shallow, well named, in a good folder, large and recent."""
    name, low = paths.basename(path), F.lower(path)
    when = lambda test, v: F.when(test, v).otherwise(0.0)
    depth = F.size(F.split(path, "/")) - 1
    score = -1.5 * depth + when(paths.stem(name).rlike(JUNK), -25.0) + when(low.rlike(POOR), -15.0) + when(low.rlike(RICH), 10.0)
    return score - 0.05 * F.length(name) + F.least(size, F.lit(1 << 30)) / float(1 << 34) - (F.lit(now) - mtime) / 86400.0 * 0.01


def guarded(path: Column) -> Column:
    """Whether a path lies in a backup, an archive or an old version."""
    return F.lower(path).rlike(GUARDED)


def ranked(groups: DataFrame, members: DataFrame, files: DataFrame, now: float) -> DataFrame:
    """Present members of groups with two or more, with ``keep_score`` and ``place``: 1 is the keeper."""
    rows = members.select("group_id", "file_id", "similarity").join(files.filter("status = 'present'").select(F.col("id").alias("file_id"), "path", "parent", "name", "size", "mtime"), "file_id")
    rows = rows.join(groups.select(F.col("id").alias("group_id"), "scan_id", "kind"), "group_id").withColumn("keep_score", keep_score(F.col("path"), F.col("mtime"), F.col("size"), now))
    own = Window.partitionBy("group_id")
    rows = rows.withColumns({"place": F.row_number().over(own.orderBy(F.desc("keep_score"), "file_id")), "present": F.count("*").over(own)})
    return rows.filter("present > 1")


def verdicts(rows: DataFrame, o: ScanOptions | None = None) -> DataFrame:
    """:func:`ranked` rows with ``action`` and ``reason``.

    In near groups all but the keeper are for review; with ``parity`` only those
    below 100. Copies in guarded folders are for review, others to be deleted.
    """
    o = o or ScanOptions()
    unlike = (F.col("kind") != "exact") & ((F.col("similarity") < 100) if o.parity else F.lit(True))
    action = F.when(F.col("place") == 1, "keep").when(unlike | guarded(F.col("path")), "review").otherwise("delete")
    reason = (
        F.when(F.col("place") == 1, F.lit("best place and name"))
        .when(unlike, F.concat(F.bround("similarity", 0).cast("int").cast("string"), F.lit("% alike; may be another version")))
        .when(guarded(F.col("path")), F.lit("kept on purpose in a backup or archive"))
        .otherwise(F.lit("same content as the kept copy"))
    )
    return rows.withColumns({"action": action, "reason": reason})


def suggestions(groups: DataFrame, members: DataFrame, files: DataFrame, now: float, o: ScanOptions | None = None) -> DataFrame:
    """One row a group: keeper, confidence, a summary, a plan to merge folders and the verdicts by file id."""
    rows = verdicts(ranked(groups, members, files, now), o)
    entry = F.struct(F.col("file_id").cast("string"), F.struct("action", "reason"))
    out = rows.groupBy("group_id", "scan_id", "kind").agg(
        F.min_by("file_id", "place").alias("keep_file_id"), F.min_by("name", "place").alias("name"), F.min_by("parent", "place").alias("folder"),
        F.count_distinct("parent").alias("folders"), F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("verdicts"),
    )
    plan = F.when(F.col("folders") > 1, F.concat(F.lit("gather in "), "folder", F.lit("; copies in "), (F.col("folders") - 1).cast("string"), F.lit(" more folders"))).otherwise(F.lit("nothing to merge: one folder"))
    return out.select("group_id", "scan_id", F.lit("heuristic").alias("source"), "keep_file_id", F.when(F.col("kind") == "exact", 90).otherwise(55).alias("confidence"), F.concat(F.lit("keep "), "name").alias("summary"), plan.alias("merge_plan"), "verdicts", F.lit(now).alias("created_at"))


class SuggestionProvider(Protocol):
    """Anything that judges groups: yields (group_id, keep_path, confidence, summary, merge_plan, [(path, action, reason)])."""

    def suggest(self, groups: list[dict]) -> Iterable[tuple]: ...


def checked(proposed: DataFrame, groups: DataFrame, members: DataFrame, files: DataFrame, now: float, source: str = "ai") -> DataFrame:
    """Suggestions of a provider, made safe.

    ``proposed``: group_id, keep_file_id, confidence, summary, merge_plan, verdicts
    (map). Unknown groups, files and actions go; confidence is held to 0..100; if no
    file or an unknown one is kept, the best by score is; guarded files and members
    of near groups are never deleted; files without a verdict are for review.
    """
    rows = ranked(groups, members, files, now).join(proposed.withColumnRenamed("keep_file_id", "wanted"), "group_id")
    rows = rows.dropDuplicates(["group_id", "file_id"])
    own = Window.partitionBy("group_id")
    keep = F.coalesce(F.max(F.when(F.col("file_id") == F.col("wanted"), F.col("file_id"))).over(own), F.min_by("file_id", "place").over(own))
    rows = rows.withColumn("keep", keep)
    said = F.try_element_at("verdicts", F.col("file_id").cast("string"))
    safe = (F.col("kind") == "exact") & ~guarded(F.col("path"))
    action = F.when(F.col("file_id") == F.col("keep"), "keep").when((said["action"] == "delete") & safe, "delete").otherwise("review")
    rows = rows.withColumn("entry", F.struct(F.col("file_id").cast("string"), F.struct(action.alias("action"), F.coalesce(said["reason"], F.lit("")).alias("reason"))))
    out = rows.groupBy("group_id", "scan_id").agg(F.min("keep").alias("keep_file_id"), F.min("confidence").alias("confidence"), F.min("summary").alias("summary"), F.min("merge_plan").alias("merge_plan"), F.map_from_entries(F.sort_array(F.collect_list("entry"))).alias("verdicts"))
    confidence = F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(F.col("confidence").cast("int"), F.lit(50))))
    return out.select("group_id", "scan_id", F.lit(source).alias("source"), "keep_file_id", confidence.alias("confidence"), "summary", "merge_plan", "verdicts", F.lit(now).alias("created_at"))


def with_fallback(own: DataFrame, fallback: DataFrame) -> DataFrame:
    """``own`` suggestions, and those of ``fallback`` for other groups."""
    return own.unionByName(fallback.join(own.select("group_id"), "group_id", "left_anti").select(own.columns))


def suggestions_by(provider: SuggestionProvider, groups: DataFrame, members: DataFrame, files: DataFrame, now: float, batch: int = 12, most: int = 300) -> DataFrame:
    """The provider's judgement of the ``most`` most wasteful groups, checked; the heuristic's for what it fails on or leaves out.

    ``most`` bounds what is asked of an outside service, and the groups it gets are
    the only rows that reach the driver.
    """
    spark = groups.sparkSession
    top = groups.orderBy(F.desc("wasted_bytes"), "id").limit(most)
    shown = ranked(top, members, files, now).groupBy("group_id").agg(F.first("kind").alias("kind"), F.sort_array(F.collect_list(F.struct("path", "file_id", "size", "mtime", "similarity"))).alias("files"))
    asked = [r.asDict(recursive=True) for r in shown.orderBy("group_id").collect()]
    ids = {g["group_id"]: {f["path"]: f["file_id"] for f in g["files"]} for g in asked}
    rows = []
    for i in range(0, len(asked), batch):
        try:
            for gid, keep, confidence, summary, plan, said in provider.suggest(asked[i : i + batch]):
                if gid in ids:
                    known = ids[gid]
                    rows.append((gid, known.get(keep), int(confidence), str(summary), str(plan), {str(known[p]): (str(a), str(r)) for p, a, r in said if p in known}))
        except Exception:  # one failed batch leaves its groups to the heuristic
            continue
    proposed = spark.createDataFrame(rows, f"group_id long, keep_file_id long, confidence int, summary string, merge_plan string, verdicts {VERDICTS}")
    return with_fallback(checked(proposed, top, members, files, now), suggestions(groups, members, files, now))


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Suggestions with those of ``new`` in place of older ones of the same groups."""
    return old.join(new.select("group_id"), "group_id", "left_anti").select(old.columns).unionByName(new.select(old.columns))


def suggest(groups: DataFrame, members: DataFrame, files: DataFrame, now: float, o: ScanOptions | None = None, engine: str = "auto", provider: SuggestionProvider | None = None, ids: Sequence[int] = ()) -> DataFrame:
    """Suggestions for all groups, or those of ``ids``, by an engine: "heuristic", "ai", which needs a provider, or "auto".

    "auto" asks the provider if there is one, else goes by the heuristic.
    """
    if engine not in ("auto", "ai", "heuristic"):
        raise ValueError(f"unknown engine {engine}")
    if engine == "ai" and provider is None:
        raise ValueError("no provider of suggestions")
    if ids:
        groups = groups.filter(F.col("id").isin(*ids))
    if engine == "heuristic" or provider is None:
        return suggestions(groups, members, files, now, o)
    return suggestions_by(provider, groups, members, files, now)


def progress(groups: DataFrame, said: DataFrame) -> DataFrame:
    """(scan_id, todo, done, by_ai, by_heuristic, sure): groups of each scan, those with a suggestion, by source and with a confidence of 80 or more."""
    own = said.select(F.col("group_id").alias("id"), "source", "confidence")
    is_ = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return groups.select("id", "scan_id").join(own, "id", "left").groupBy("scan_id").agg(
        F.count("*").alias("todo"), F.count("source").alias("done"), is_(F.col("source") == "ai").alias("by_ai"), is_(F.col("source") == "heuristic").alias("by_heuristic"), is_(F.col("confidence") >= 80).alias("sure")
    )
