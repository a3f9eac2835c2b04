"""Schemas of the engine's own tables."""

from __future__ import annotations

TABLES = {
    "scans": "id long, root string, state string, phase string, started_at double, finished_at double, files_seen long, bytes_seen long, files_hashed long, bytes_hashed long, groups_found long, wasted_bytes long, options string, error string",
    "files": "id long, scan_id long, path string, parent string, name string, ext string, size long, mtime double, dev long, inode long, nlink long, quick string, md5 string, fuzzy string, dhash long, status string",
    "groups": "id long, scan_id long, kind string, signature string, similarity double, verified boolean, file_count long, total_bytes long, wasted_bytes long, max_size long, folder_span long, label string",
    "group_members": "group_id long, file_id long, similarity double",
    "suggestions": "group_id long, scan_id long, source string, keep_file_id long, confidence int, summary string, merge_plan string, verdicts map<string,struct<action:string,reason:string>>, created_at double",
    "actions": "id long, scan_id long, file_id long, action string, src_path string, dst_path string, size long, ok boolean, message string, created_at double",
    "hash_cache": "path string, size long, mtime double, quick string, md5 string, fuzzy string, dhash long, seen_at double",
    "dir_cache": "path string, mtime double, scan_id long, seen_at double",
    "verify_cache": "a_path string, a_size long, a_mtime double, b_path string, b_size long, b_mtime double, same boolean, seen_at double",
    "status_log": "file_id long, status string, seq long",
}
