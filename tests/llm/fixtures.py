"""Small corpora and plain-Python versions of what the operators share."""

import random

import regex

_ALONE = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Myanmar}\p{Khmer}]"
WORD = regex.compile(rf"[{_ALONE}&&[\p{{L}}\p{{M}}\p{{N}}]]|[[\p{{L}}\p{{M}}\p{{N}}_]--{_ALONE}]+", regex.V1)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").lower())


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def prose(r, n, vocabulary=4000):
    out = []
    for i in range(n):
        w = f"w{r.randrange(vocabulary)}"
        out.append(w.capitalize() + "." if i % 12 == 11 else w)
    return " ".join(out)


def frame(spark, rows, schema=DOCS):
    """Rows of (doc_id, text, ...), filled up with what the schema needs."""
    full = [(i, t, "en", "src1", len(t) if t is not None else None) if len((i, t, *rest)) == 2 else (i, t, *rest) for i, t, *rest in rows]
    return spark.createDataFrame(full, schema).repartition(3)


def corpus(seed=1, n=60):
    """Documents with copies that share from all to almost none of their words."""
    r = random.Random(seed)
    out = {}
    for i in range(n):
        if i % 3 == 0 or i < 3:
            out[i] = prose(r, r.randint(40, 200))
        else:
            w = out[i - i % 3].split()
            share = r.choice([0.0, 0.01, 0.03, 0.1, 0.3])
            out[i] = " ".join(f"x{r.randrange(9999)}" if r.random() < share else x for x in w)
    return out


#: Names that the operators use inside.
CLASH = "a b node component sig whole nodes sure key seen size count n quality score keep y toxic severe words tokens shard window item_id shingles containment first_word label fp at begin stop rid preview duplicate_of bad sketch".split()
