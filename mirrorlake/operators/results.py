"""Questions to a finished scan: pages of groups, details, reports, logs, usage."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorlake.functions.images import EXTENSIONS, meta_column

SORTS = {"similarity": "similarity", "wasted": "wasted_bytes", "size": "total_bytes", "largest": "max_size", "count": "file_count", "folders": "folder_span", "name": "label", "id": "id", "confidence": "sugg_confidence"}


def _number(value: object, kind: type) -> float | int:
    try:
        return kind(value)
    except (TypeError, ValueError):
        return 0


@dataclass(frozen=True)
class GroupParams:
    """Filters, order and page of a list of groups. Values that make no sense are as if not given."""

    kind: str = "all"
    min_similarity: float = 0.0
    min_size: int = 0
    q: str = ""
    suggested_only: bool = False
    sort: str = "wasted"
    dir: str = "desc"
    limit: int = 100
    offset: int = 0

    @classmethod
    def of(cls, query: Mapping[str, object]) -> GroupParams:
        """From the strings of a query."""
        s = {k: str(v[0] if isinstance(v, list) else v).strip() for k, v in query.items()}
        return cls(
            s.get("kind", "all"), _number(s.get("min_similarity"), float), int(_number(s.get("min_size"), int)), s.get("q", ""), s.get("suggested_only", "0") in ("1", "true"),
            s.get("sort", "wasted"), s.get("dir", "desc"), int(_number(s.get("limit", 100), int)) or 100, int(_number(s.get("offset"), int)),
        )


def present_members(members: DataFrame, files: DataFrame) -> DataFrame:
    return members.select("group_id", "file_id").join(files.filter("status = 'present'").select(F.col("id").alias("file_id"), "size", "parent"), "file_id")


def present_stats(members: DataFrame, files: DataFrame) -> DataFrame:
    """What is left of each group: (group_id, files, largest, wasted, folders); groups without present files have no row."""
    rows = present_members(members, files).groupBy("group_id")
    wasted = F.when(F.count("*") > 1, F.sum("size") - F.max("size")).otherwise(0)
    return rows.agg(F.count("*").alias("files"), F.max("size").alias("largest"), wasted.alias("wasted"), F.count_distinct("parent").alias("folders"))


def like_literal(text: str) -> str:
    """``text`` as the middle of a LIKE pattern in which % and _ keep their meaning."""
    return "%" + text.replace("\\", "\\\\") + "%"


def matching_groups(groups: DataFrame, members: DataFrame, files: DataFrame, suggestions: DataFrame, p: GroupParams, stats: DataFrame | None = None) -> DataFrame:
    """Groups that pass the filters and still have two present files, with their suggestion's columns."""
    rows = groups
    tests: list[Column] = []
    if p.kind in ("exact", "near"):
        tests.append(F.col("kind") == p.kind)
    if p.min_similarity > 0:
        tests.append(F.col("similarity") >= p.min_similarity)
    if p.min_size > 0:
        tests.append(F.col("max_size") >= p.min_size)
    if tests:
        rows = rows.filter(reduce(lambda a, b: a & b, tests))
    if p.q:
        hits = files.filter(F.col("path").ilike(like_literal(p.q))).select(F.col("id").alias("file_id"))
        rows = rows.join(members.join(hits, "file_id", "left_semi").select(F.col("group_id").alias("id")), "id", "left_semi")
    said = suggestions.select(F.col("group_id").alias("id"), F.col("source").alias("sugg_source"), F.col("confidence").alias("sugg_confidence"), F.col("summary").alias("sugg_summary"), "keep_file_id", "merge_plan")
    rows = rows.join(said, "id", "inner" if p.suggested_only else "left")
    live = (stats if stats is not None else present_stats(members, files)).filter("files > 1").withColumnRenamed("group_id", "id")
    return rows.join(live, "id")


def groups_page(groups: DataFrame, members: DataFrame, files: DataFrame, suggestions: DataFrame, p: GroupParams | None = None) -> DataFrame:
    """One page of groups; counts are of present files, sorting and filters of the scan's own.

    At most 500 rows; a negative limit means all. Nulls come first in rising order.
    """
    p = p or GroupParams()
    rows = matching_groups(groups, members, files, suggestions, p)
    column = F.col(SORTS.get(p.sort, SORTS["wasted"]))
    rows = rows.orderBy(column.asc_nulls_first() if p.dir.lower() == "asc" else column.desc_nulls_last(), F.col("id").asc())
    if p.offset > 0:
        rows = rows.offset(p.offset)
    if p.limit >= 0:
        rows = rows.limit(min(p.limit, 500))
    own = [c for c in groups.columns if c not in ("file_count", "max_size", "wasted_bytes", "folder_span")]
    return rows.select(*own, F.col("files").alias("file_count"), F.col("largest").alias("max_size"), F.col("wasted").alias("wasted_bytes"), F.col("folders").alias("folder_span"), "sugg_source", "sugg_confidence", "sugg_summary", "keep_file_id", "merge_plan")


def groups_total(groups: DataFrame, members: DataFrame, files: DataFrame, suggestions: DataFrame, p: GroupParams | None = None) -> DataFrame:
    return matching_groups(groups, members, files, suggestions, p or GroupParams()).agg(F.count("*").alias("total"))


def groups_summary(groups: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """(groups, wasted, files) over all groups of the scan with two present files, whatever a page filters."""
    live = present_stats(members.join(groups.select(F.col("id").alias("group_id")), "group_id", "left_semi"), files).filter("files > 1")
    return live.agg(F.count("*").alias("groups"), F.coalesce(F.sum("wasted"), F.lit(0)).alias("wasted"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"))


def group_members(members: DataFrame, files: DataFrame, suggestions: DataFrame, with_meta: bool = False) -> DataFrame:
    """Members with file columns and their verdict, by group, size and path.

    ``with_meta`` reads pictures from ``content``; otherwise that column isn't read.
    """
    cols = ["path", "parent", "name", "ext", "size", "mtime", "status", "md5", *(["content"] if with_meta else [])]
    rows = members.select("group_id", "file_id", "similarity").join(files.select(F.col("id").alias("file_id"), *cols), "file_id")
    rows = rows.join(suggestions.select("group_id", "verdicts"), "group_id", "left")
    said = F.try_element_at("verdicts", F.col("file_id").cast("string"))
    image = F.coalesce(F.lower("ext").isin(*EXTENSIONS), F.lit(False))
    rows = rows.withColumns({"action": said["action"], "reason": said["reason"], "is_image": image}).drop("verdicts")
    if with_meta:
        rows = rows.withColumn("meta", F.when(F.col("is_image") & (F.col("status") == "present"), meta_column(F.col("content")))).drop("content")
    return rows.orderBy("group_id", F.desc("size"), "path")


def one_group(groups: DataFrame, members: DataFrame, files: DataFrame, suggestions: DataFrame, group: int, with_meta: bool = False) -> DataFrame:
    """The group's row with its files as a list and its suggestion as a struct; no row if unknown."""
    rows = group_members(members.filter(F.col("group_id") == group), files, suggestions, with_meta)
    own = [F.col(c) for c in rows.columns if c not in ("group_id",)]
    entry = F.struct((-F.col("size")).alias("_order"), F.col("path").alias("_path"), F.struct(*own).alias("file"))
    listed = rows.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["file"]).alias("files"))
    said = suggestions.filter(F.col("group_id") == group).select("group_id", F.struct(*(c for c in suggestions.columns)).alias("suggestion"))
    return groups.filter(F.col("id") == group).join(listed.withColumnRenamed("group_id", "id"), "id", "left").join(said.withColumnRenamed("group_id", "id"), "id", "left")


def report_top(groups: DataFrame, suggestions: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` groups that waste most, with their suggestion's summary and confidence."""
    said = suggestions.select(F.col("group_id").alias("id"), "summary", "confidence")
    return groups.join(said, "id", "left").orderBy(F.desc("wasted_bytes"), "id").limit(n)


def latest_scan(scans: DataFrame, scan_id: int | None = None, running: int | None = None) -> DataFrame:
    """(id): the scan asked for, else the running one, else the last that was done or cancelled."""
    known = scan_id if scan_id is not None else running
    if known is not None:
        return scans.filter(F.col("id") == known).select("id")
    return scans.filter(F.col("state").isin("done", "cancelled")).agg(F.max("id").alias("id")).filter("id is not null")


def previous_scan(scans: DataFrame, scan_id: int, root: str) -> DataFrame:
    """(id): the last scan of this very root before this one that ran to its end."""
    return scans.filter((F.col("root") == root) & (F.col("state") == "done") & (F.col("id") < scan_id)).agg(F.max("id").alias("id")).filter("id is not null")


def recent_scans(scans: DataFrame, n: int = 50) -> DataFrame:
    return scans.orderBy(F.desc("id")).limit(n)


def action_log(actions: DataFrame, scan_id: int | None = None, n: int = 200) -> DataFrame:
    rows = actions if scan_id is None else actions.filter(F.col("scan_id") == scan_id)
    return rows.orderBy(F.desc("id")).limit(min(n, 1000))


def badge(kind: Column, similarity: Column) -> Column:
    """Class of a similarity: exact, high from 90, mid from 75, else low."""
    return F.when(kind == "exact", "exact").when(similarity >= 90, "high").when(similarity >= 75, "mid").otherwise("low")


def suggested_selection(members: DataFrame, files: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(group_id, file_id) of present files that their suggestion would delete."""
    said = suggestions.select("group_id", F.explode("verdicts").alias("key", "v")).filter("v.action = 'delete'").select("group_id", F.col("key").cast("long").alias("file_id"))
    live = files.filter("status = 'present'").select(F.col("id").alias("file_id"))
    return said.join(members.select("group_id", "file_id"), ["group_id", "file_id"], "left_semi").join(live, "file_id", "left_semi").select("group_id", "file_id")


def usage(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, rows) of each table."""
    counts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def usage_by_scan(scans: DataFrame, files: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, root, state, files, groups) of each scan, newest first."""
    n = lambda df, name: df.groupBy(F.col("scan_id").alias("id")).agg(F.count("*").alias(name))
    rows = scans.select("id", "root", "state").join(n(files, "files"), "id", "left").join(n(groups, "groups"), "id", "left")
    return rows.fillna(0, ["files", "groups"]).orderBy(F.desc("id"))


def scan_counters(files: DataFrame, groups: DataFrame) -> DataFrame:
    """Counters of each scan: files, bytes, hashed files and bytes, groups, wasted bytes."""
    hashed = F.col("md5").isNotNull()
    a = files.groupBy("scan_id").agg(F.count("*").alias("files_seen"), F.sum("size").alias("bytes_seen"), F.count_if(hashed).alias("files_hashed"), F.coalesce(F.sum(F.when(hashed, F.col("size"))), F.lit(0)).alias("bytes_hashed"))
    b = groups.groupBy("scan_id").agg(F.count("*").alias("groups_found"), F.sum("wasted_bytes").alias("wasted_bytes"))
    return a.join(b, "scan_id", "left").fillna(0, ["groups_found", "wasted_bytes"])
