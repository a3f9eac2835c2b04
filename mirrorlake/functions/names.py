"""How alike two file or folder names are."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mirrorlake.functions.paths import C, _col, basename, stem

_MARKER = r"[-_\s]*[(]?\b(?:" + "|".join(("copia", "copy", "kopie")) + r"|[0-9]{1,3})[)]?$"

#: Folder names of one line mean the same.
SYNONYMS = tuple(
    frozenset(line.split())
    for line in """
    bild bilder foto fotos image images img imgs photo photos pic pics picture pictures
    clip clips film filme movie movies vid video videos vids
    doc docs document documents dokument dokumente
    backup backups bak sicherung sicherungen
    dl download downloads
    audio music musik song songs sound sounds
    alt archiv archive archives old
    neu neue new
    temp temporary tmp
    """.strip().splitlines()
)


def bare_name(name: C) -> Column:
    """The stem in lower case without a marker of copies at its end, letters a-z and digits only."""
    marked = F.regexp_replace(F.lower(stem(name)), _MARKER, "")
    return F.regexp_replace(marked, "[^a-z0-9]+", "")


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float] = {}
    out = []
    for x, y in zip(a, b, strict=True):
        if not x or not y:
            out.append(0.0)
            continue
        got = known.get((x, y))
        if got is None:
            got = known[x, y] = 1.0 if x == y else SequenceMatcher(None, x, y).ratio()
        out.append(got)
    return pd.Series(out, dtype="float64")


def name_similarity(a: C, b: C) -> Column:
    """0 to 1 by matching blocks of the bare names; the order of arguments can matter. 0 if either is bare of letters."""
    return _ratio(bare_name(a), bare_name(b))


def normal_folder(name: C) -> Column:
    """Letters and digits in lower case without the ending of a plural, unless nothing is left."""
    low = F.regexp_replace(F.lower(_col(name)), "[^a-z0-9]+", "")
    return F.coalesce(F.nullif(F.regexp_replace(low, "e?s$", ""), F.lit("")), low)


def kinship(a: C, b: C, similar: Column | None = None) -> Column:
    """Struct (related, why) for the last names of two folder paths.

    ``similar`` is the similarity of the names for the last test; without it that
    is computed by :func:`name_similarity`.
    """
    x, y = basename(a), basename(b)
    lx, ly, nx, ny = F.lower(x), F.lower(y), normal_folder(x), normal_folder(y)
    groups = F.create_map(*(F.lit(v) for k, words in enumerate(SYNONYMS) for w in sorted(words) for v in (w, k)))
    same_group = (groups[lx] == groups[ly]) | (groups[nx] == groups[ny])
    prefix = (nx != "") & (ny != "") & (nx.startswith(ny) | ny.startswith(nx)) & (F.abs(F.length(nx) - F.length(ny)) <= 4)
    near = name_similarity(x, y) if similar is None else similar
    why = (
        F.when((x == "") | (y == ""), F.lit(""))
        .when(lx == ly, F.lit("same name"))
        .when((nx != "") & (nx == ny), F.lit("same word in another form"))
        .when(F.coalesce(same_group, F.lit(False)), F.lit("synonyms"))
        .when(prefix, F.lit("one begins like the other"))
        .when(near >= 0.85, F.lit("much alike"))
        .otherwise(F.lit(""))
    )
    return F.struct((why != "").alias("related"), why.alias("why"))
