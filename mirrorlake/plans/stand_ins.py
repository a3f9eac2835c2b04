"""A finished scan of the test tables: groups, members, suggestions, a log and caches to ask questions about.

Exact groups are real. Near groups, logs and caches are stand-ins made by
arithmetic, so that SQL can say the same; the real near pass has its own queries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorlake.operators import exact, groups, suggest
from mirrorlake.operators.lineage import cut
from mirrorlake.sources import catalogue

NOW = 1767225600.0


@dataclass(frozen=True)
class Scan:
    files: DataFrame
    groups: DataFrame
    members: DataFrame
    suggestions: DataFrame


def near_members(files: DataFrame) -> DataFrame:
    """Files of one size that aren't all equal; the least id represents them."""
    rows = files.filter("size > 0").groupBy("size").agg(F.min("id").alias("rep"), F.min("md5").alias("x"), F.max("md5").alias("y")).filter("x <> y")
    one = files.select("size", F.col("id").alias("file_id")).join(rows, "size").select(groups.group_id(F.col("rep"), "near").alias("group_id"), "rep", "file_id")
    sim = F.when(F.col("file_id") == F.col("rep"), 100.0).otherwise((F.col("file_id") % 40 + 60).cast("double"))
    return one.select("group_id", "file_id", sim.alias("similarity"), F.lit(None).cast("string").alias("signature"), F.lit(False).alias("verified"))


def scan(spark: SparkSession, sf_dir: str) -> Scan:
    docs = catalogue.documents(spark, sf_dir)
    files = cut(docs.drop("content"))  # as a store would have it: contents are hashed once
    clusters = exact.verified_clusters(docs)
    found = cut(groups.exact_members(clusters).unionByName(near_members(files)))
    kind = lambda nth: found.filter(F.col("group_id") % 2 == nth)
    rows = cut(groups.group_rows(kind(0), files, "exact").unionByName(groups.group_rows(kind(1), files, "near")))
    members = found.select("group_id", "file_id", "similarity")
    return Scan(files, rows, members, suggest.suggestions(rows, members, files, NOW))


_GROUP = """min(f.scan_id) AS scan_id, '{k}' AS kind, {sig} AS signature, {sim} AS similarity, {v} AS verified, count(*) AS file_count, CAST(sum(f.size) AS BIGINT) AS total_bytes,
  CAST(sum(f.size) - max(f.size) AS BIGINT) AS wasted_bytes, max(f.size) AS max_size, count(DISTINCT f.parent) AS folder_span, arg_min(f.name, f.id) AS label"""

SCAN_SQL = f"""
WITH {catalogue.FILES_SQL},
exact_ids AS (SELECT 2 * min(id) AS group_id, md5, size FROM files WHERE size > 0 GROUP BY md5, size HAVING count(*) > 1),
near_ids AS (SELECT 2 * min(id) + 1 AS group_id, size FROM files WHERE size > 0 GROUP BY size HAVING min(md5) <> max(md5)),
group_members AS (
  SELECT e.group_id, f.id AS file_id, CAST(100 AS DOUBLE) AS similarity FROM exact_ids e JOIN files f ON f.md5 = e.md5 AND f.size = e.size
  UNION ALL
  SELECT n.group_id, f.id, CASE WHEN 2 * f.id + 1 = n.group_id THEN CAST(100 AS DOUBLE) ELSE CAST(f.id % 40 + 60 AS DOUBLE) END FROM near_ids n JOIN files f ON f.size = n.size),
groups AS (
  SELECT e.group_id AS id, {_GROUP.format(k="exact", sig="min(e.md5)", sim="CAST(100 AS DOUBLE)", v="true")} FROM exact_ids e JOIN files f ON f.md5 = e.md5 AND f.size = e.size GROUP BY e.group_id
  UNION ALL
  SELECT m.group_id, {_GROUP.format(k="near", sig="CAST(NULL AS VARCHAR)", sim="round_even((sum(m.similarity) - 100) / (count(*) - 1), 1)", v="false")}
  FROM group_members m JOIN files f ON f.id = m.file_id WHERE m.group_id % 2 = 1 GROUP BY m.group_id),
scored AS (
  SELECT m.group_id, m.file_id, m.similarity, g.kind, g.scan_id, f.path, f.parent, f.name,
    -1.5 * (len(string_split(f.path, '/')) - 1) + CASE WHEN regexp_matches(regexp_replace(f.name, '[.]txt$', ''), '{suggest.JUNK}') THEN -25.0 ELSE 0.0 END
    + CASE WHEN regexp_matches(lower(f.path), '{suggest.POOR}') THEN -15.0 ELSE 0.0 END + CASE WHEN regexp_matches(lower(f.path), '{suggest.RICH}') THEN 10.0 ELSE 0.0 END
    - CAST(0.05 AS DOUBLE) * length(f.name) + least(f.size, 1073741824) / CAST(17179869184 AS DOUBLE) - (CAST({NOW} AS DOUBLE) - f.mtime) / CAST(86400 AS DOUBLE) * CAST(0.01 AS DOUBLE) AS keep_score
  FROM group_members m JOIN groups g ON g.id = m.group_id JOIN files f ON f.id = m.file_id WHERE f.status = 'present'),
ranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY keep_score DESC, file_id) AS place, count(*) OVER (PARTITION BY group_id) AS present FROM scored) WHERE present > 1),
verdicts AS (
  SELECT *, CASE WHEN place = 1 THEN 'keep' WHEN kind <> 'exact' OR regexp_matches(lower(path), '{suggest.GUARDED}') THEN 'review' ELSE 'delete' END AS action FROM ranked),
suggestions AS (
  SELECT group_id, min(scan_id) AS scan_id, 'heuristic' AS source, arg_min(file_id, place) AS keep_file_id, CAST(CASE WHEN min(kind) = 'exact' THEN 90 ELSE 55 END AS INTEGER) AS confidence,
    'keep ' || arg_min(name, place) AS summary,
    CASE WHEN count(DISTINCT parent) > 1 THEN 'gather in ' || arg_min(parent, place) || '; copies in ' || (count(DISTINCT parent) - 1) || ' more folders' ELSE 'nothing to merge: one folder' END AS merge_plan
  FROM verdicts GROUP BY group_id),
live AS (
  SELECT m.group_id, count(*) AS files, max(f.size) AS largest, CAST(CASE WHEN count(*) > 1 THEN sum(f.size) - max(f.size) ELSE 0 END AS BIGINT) AS wasted, count(DISTINCT f.parent) AS folders
  FROM group_members m JOIN files f ON f.id = m.file_id WHERE f.status = 'present' GROUP BY m.group_id),
matching AS (
  SELECT g.*, s.source AS sugg_source, s.confidence AS sugg_confidence, s.summary AS sugg_summary, s.keep_file_id, s.merge_plan, l.files, l.largest, l.wasted, l.folders
  FROM groups g LEFT JOIN suggestions s ON s.group_id = g.id JOIN live l ON l.group_id = g.id WHERE l.files > 1)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan for each hundred events, over five roots, in the four states."""
    n = F.floor(F.col("event_id") / 100).cast("long")
    rows = events(spark, sf_dir).groupBy(n.alias("id")).agg(F.count("*").alias("files_seen"))
    state = F.element_at(F.array(*map(F.lit, ("done", "done", "cancelled", "error", "running"))), (F.col("id") % 5 + 1).cast("int"))
    return rows.select("id", F.concat(F.lit("/corpus/"), (F.col("id") % 3).cast("string")).alias("root"), state.alias("state"), "files_seen", (F.col("id") * 10.0).alias("started_at"), F.when(F.col("id") % 5 < 3, F.col("id") * 10.0 + 5).alias("finished_at"), F.lit(None).cast("string").alias("error"))


SCANS_SQL = """
scans AS (
  SELECT event_id // 100 AS id, '/corpus/' || (event_id // 100) % 3 AS root, ['done', 'done', 'cancelled', 'error', 'running'][(event_id // 100) % 5 + 1] AS state, count(*) AS files_seen,
         CAST((event_id // 100) * 10 AS DOUBLE) AS started_at, CASE WHEN (event_id // 100) % 5 < 3 THEN CAST((event_id // 100) * 10 + 5 AS DOUBLE) END AS finished_at, CAST(NULL AS VARCHAR) AS error
  FROM events GROUP BY event_id // 100)
"""


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files of those scans: (id, scan_id, size, md5)."""
    return events(spark, sf_dir).select(F.col("event_id").alias("id"), F.floor(F.col("event_id") / 100).cast("long").alias("scan_id"), F.col("user_id").alias("size"), F.when(F.col("event_type") != "error", F.md5("props")).alias("md5"))


def scan_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of those scans: (id, scan_id, wasted_bytes)."""
    rows = scan_files(spark, sf_dir).groupBy("scan_id", "md5").agg(F.min("id").alias("id"), F.count("*").alias("n"), (F.sum("size") - F.max("size")).alias("wasted_bytes"))
    return rows.filter("n > 1 and md5 is not null").select("id", "scan_id", "wasted_bytes")


SCAN_FILES_SQL = """
scan_files AS (SELECT event_id AS id, event_id // 100 AS scan_id, user_id AS size, CASE WHEN event_type <> 'error' THEN md5(props) END AS md5 FROM events),
scan_groups AS (SELECT min(id) AS id, scan_id, CAST(sum(size) - max(size) AS BIGINT) AS wasted_bytes FROM scan_files WHERE md5 IS NOT NULL GROUP BY scan_id, md5 HAVING count(*) > 1)
"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of actions."""
    kinds = F.create_map(*(F.lit(x) for kv in (("view", "simulate:quarantine"), ("click", "quarantine"), ("purchase", "permanent"), ("signup", "link"), ("error", "restore")) for x in kv))
    e = events(spark, sf_dir)
    return e.select(
        F.col("event_id").alias("id"), (F.col("event_id") % 4).alias("scan_id"), F.col("user_id").alias("file_id"), kinds[F.col("event_type")].alias("action"),
        F.concat(F.lit("/corpus/u"), F.col("user_id").cast("string")).alias("src_path"), F.when(F.col("event_type") != "purchase", F.concat(F.lit("/trash/e"), F.col("event_id").cast("string"))).alias("dst_path"),
        (F.col("event_id") % 1000).alias("size"), (F.col("event_id") % 7 != 0).alias("ok"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created"),
    )


ACTIONS_SQL = """
actions AS (
  SELECT event_id AS id, event_id % 4 AS scan_id, user_id AS file_id,
         CASE event_type WHEN 'view' THEN 'simulate:quarantine' WHEN 'click' THEN 'quarantine' WHEN 'purchase' THEN 'permanent' WHEN 'signup' THEN 'link' WHEN 'error' THEN 'restore' END AS action,
         '/corpus/u' || user_id AS src_path, CASE WHEN event_type <> 'purchase' THEN '/trash/e' || event_id END AS dst_path, event_id % 1000 AS size, event_id % 7 <> 0 AS ok, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created
  FROM events)
"""


def hash_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations of file versions; each has some of the hashes only."""
    e = events(spark, sf_dir)
    on = lambda kind: F.when(F.col("event_type") == kind, F.md5("props"))
    return e.select(
        F.concat(F.lit("/corpus/u"), F.col("user_id").cast("string")).alias("path"), (F.col("user_id") % 13 + F.floor(F.col("event_id") / 5000)).cast("long").alias("size"), (F.col("user_id") * 60 + catalogue.EPOCH).cast("double").alias("mtime"),
        on("view").alias("quick"), on("click").alias("md5"), on("purchase").alias("fuzzy"), F.when(F.col("event_type") == "signup", F.col("event_id")).alias("dhash"), F.col("event_id").cast("double").alias("seen_at"),
    )


HASH_LOG_SQL = f"""
hash_log AS (
  SELECT '/corpus/u' || user_id AS path, user_id % 13 + event_id // 5000 AS size, CAST(user_id * 60 + {catalogue.EPOCH} AS DOUBLE) AS mtime, CASE event_type WHEN 'view' THEN md5(props) END AS quick,
         CASE event_type WHEN 'click' THEN md5(props) END AS md5, CASE event_type WHEN 'purchase' THEN md5(props) END AS fuzzy, CASE event_type WHEN 'signup' THEN event_id END AS dhash, CAST(event_id AS DOUBLE) AS seen_at
  FROM events),
hash_cache AS (
  SELECT path, size, mtime, arg_max(quick, seen_at) FILTER (WHERE quick IS NOT NULL) AS quick, arg_max(md5, seen_at) FILTER (WHERE md5 IS NOT NULL) AS md5, arg_max(fuzzy, seen_at) FILTER (WHERE fuzzy IS NOT NULL) AS fuzzy,
         arg_max(dhash, seen_at) FILTER (WHERE dhash IS NOT NULL) AS dhash, max(seen_at) AS seen_at
  FROM hash_log GROUP BY path, size, mtime)
"""
