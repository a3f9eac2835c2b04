"""What a scan can be told, with defaults."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace

TRASH = ".mirrorlake-trash"
_DIRS = ("$RECYCLE.BIN", "lost+found", "node_modules", "System Volume Information", TRASH)
_DIRS += tuple(f"@{x}" for x in ("S2S", "eaDir", "sharebin", "sharesnap", "synologydrive", "synothumb", "tmp"))
_DIRS += tuple(f".{x}" for x in ("git", "svn")) + tuple(f"#{x}" for x in ("recycle", "snapshot"))


@dataclass(frozen=True)
class ScanOptions:
    """Parameters that change what a scan finds. Zero as a largest size means no limit.

    ``parity`` repeats two choices of older tools: signatures of unlike block sizes
    are compared slot by slot, and the representative of a near group may be
    proposed for deletion. ``report_linked_exact`` also reports near groups made
    only of members of exact groups.
    """

    roots: tuple[str, ...] = ()
    exclude_dirs: tuple[str, ...] = _DIRS
    exclude_globs: tuple[str, ...] = (".DS_Store", "Thumbs.db", "*.crdownload", "*.part", "*.!sync")
    min_size: int = 1
    max_size: int = 0
    follow_symlinks: bool = False
    quick_rescan: bool = False
    verify_bytes: bool = True
    near_duplicates: bool = True
    near_threshold: int = 70
    fuzzy_min_size: int = 4096
    fuzzy_max_size: int = 512 << 20
    fuzzy_max_bytes: int = 4 << 20
    fuzzy_skip_exts: tuple[str, ...] = ()
    image_similarity: bool = True
    delete_mode: str = "quarantine"
    protect_last_copy: bool = True
    dry_run: bool = False
    parity: bool = False
    report_linked_exact: bool = False

    def updated(self, values: Mapping[str, object]) -> ScanOptions:
        """With the given values, each made the type of the default; unknown names are ignored."""
        new: dict[str, object] = {}
        for f in fields(self):
            if f.name in values:
                old, v = getattr(self, f.name), values[f.name]
                if isinstance(old, bool):
                    new[f.name] = v.strip().lower() in ("1", "true", "yes", "on") if isinstance(v, str) else bool(v)
                elif isinstance(old, int):
                    new[f.name] = int(v)
                elif isinstance(old, tuple):
                    new[f.name] = tuple([v] if isinstance(v, str) else v)
                else:
                    new[f.name] = type(old)(v)
        return replace(self, **new)

    @classmethod
    def load(cls, path: str) -> ScanOptions:
        """From a JSON file; values it lacks are the defaults, which also stand for one that can't be read. A missing file is made."""
        o = cls()
        try:
            with open(path, encoding="utf-8") as f:
                stored = json.load(f)
            return o.updated(stored) if isinstance(stored, dict) else o
        except FileNotFoundError:
            o.save(path)
        except (OSError, ValueError, TypeError):
            pass
        return o

    def save(self, path: str) -> None:
        """As JSON, in place of what was there at once or not at all."""
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path + ".new", "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=1, sort_keys=True)
        os.replace(path + ".new", path)
