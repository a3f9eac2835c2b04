"""Chat formatting of typed content parts.

A message is plain text, or a JSON list of parts, each with a ``type``: text,
image, audio or document. A visitor has one method for each type; it builds the
column expressions that flatten a part to text or to a numbered placeholder and
that count the tokens it expands to. Everything stays in the JVM, and a
conversation is put together by one shuffle on its id.

Text can't forge turns or placeholders: a backslash goes after the first character
of any mark that stands in a text or role. As texts with such backslashes get one
more, taking one away gives back what was written.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = "array<struct<type:string,text:string,url:string,width:long,height:long,seconds:double,pages:long>>"


@dataclass(frozen=True)
class ChatOptions:
    """Token rates: bytes of text for a token, pixels of an image patch, and so on."""

    bytes_per_token: int = 4
    patch: int = 28
    tokens_per_second: int = 25
    tokens_per_page: int = 512
    open_turn: str = "<|"
    close_role: str = "|>\n"
    close_turn: str = "<|end|>\n"


class PartVisitor:
    """What a part of each type becomes: its text, and how many tokens.

    ``part`` is a struct column with the fields of :data:`PARTS`. A missing size
    counts as one patch, second or page.
    """

    def __init__(self, options: ChatOptions):
        self.o = options

    def attachment(self, kind: str, n: Column) -> Column:
        return F.concat(F.lit(f"<{kind}_"), n.cast("string"), F.lit(">"))

    def guarded(self, text: Column, *more: str) -> Column:
        """``text`` with a backslash inside whatever looks like a mark."""
        marks = [self.o.open_turn, self.o.close_turn, *(f"<{k}_" for k in ATTACHED), *more]
        for first in dict.fromkeys(m[0] for m in marks if len(m) > 1):
            rest = "|".join(dict.fromkeys(re.escape(m[1:]) for m in marks if m[0] == first and len(m) > 1))
            text = F.regexp_replace(text, rf"{re.escape(first)}(\\*(?:{rest}))", re.sub(r"([\\$])", r"\\\1", first) + r"\\$1")
        return text

    def text(self, part: Column, n: Column) -> tuple[Column, Column]:
        text = F.coalesce(part["text"], F.lit(""))
        return self.guarded(text), self.text_tokens(text)

    def text_tokens(self, text: Column) -> Column:
        return F.floor((F.octet_length(text) + self.o.bytes_per_token - 1) / self.o.bytes_per_token).cast("long")

    def image(self, part: Column, n: Column) -> tuple[Column, Column]:
        side = lambda c: F.ceil(F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) / self.o.patch)
        return self.attachment("image", n), (side(part["width"]) * side(part["height"])).cast("long")

    def audio(self, part: Column, n: Column) -> tuple[Column, Column]:
        seconds = F.greatest(F.coalesce(part["seconds"], F.lit(1.0)), F.lit(0.0))
        return self.attachment("audio", n), F.greatest(F.ceil(seconds * self.o.tokens_per_second), F.lit(1)).cast("long")

    def document(self, part: Column, n: Column) -> tuple[Column, Column]:
        return self.attachment("document", n), (F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * self.o.tokens_per_page).cast("long")

    def visit(self, part: Column, n: Column) -> Column:
        """Struct of text and tokens; an unknown type is written like text."""
        shown, tokens = self.text(part, n)
        for kind in ATTACHED:
            s, t = getattr(self, kind)(part, n)
            shown, tokens = F.when(part["type"] == kind, s).otherwise(shown), F.when(part["type"] == kind, t).otherwise(tokens)
        return F.struct(shown.alias("shown"), tokens.alias("tokens"))


ATTACHED = ("image", "audio", "document")


def parts(text: Column) -> Column:
    """The parts of a message: those of a JSON list whose entries all have a type, else one text."""
    plain = F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in (("url", "string"), ("width", "long"), ("height", "long"), ("seconds", "double"), ("pages", "long")))))
    read = F.from_json(text, PARTS)
    typed = F.ltrim(text).startswith("[") & (F.size(read) > 0) & F.forall(read, lambda p: p.isNotNull() & p["type"].isNotNull())
    return F.when(F.coalesce(typed, F.lit(False)), read).otherwise(plain)


def format_chats(turns: DataFrame, options: ChatOptions | None = None) -> DataFrame:
    """(conv_id, formatted, n_messages, n_attachments, attachments, n_tokens) of each conversation.

    Messages stand in the order of turn, then role and text, nulls first; equal
    rows are all kept. Attachments are numbered from 0 through a conversation and
    recorded as {n, kind, ref, tokens}. A null role is "unknown", a null text
    empty; rows without a conv_id are left out. ``n_tokens`` counts the text and
    what attachments expand to, without the turn marks and the backslashes that
    guard against forged ones. No rows give no rows.
    """
    o = options or ChatOptions()
    visitor = PartVisitor(o)
    told = turns.filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), "text", parts(F.col("text")).alias("parts"))
    attached = F.filter("parts", lambda p: p["type"].isin(*ATTACHED))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    told = told.withColumn("own", F.size(attached)).withColumn("before", F.coalesce(F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    told = told.withColumn("place", F.row_number().over(order))
    upto = lambda i: F.col("before") + F.size(F.filter(F.slice("parts", F.lit(1), i), lambda p: p["type"].isin(*ATTACHED)))
    seen = F.transform("parts", lambda p, i: F.struct(p["type"].alias("kind"), p["url"].alias("ref"), upto(i).cast("long").alias("n"), visitor.visit(p, upto(i)).alias("v")))
    told = told.withColumn("seen", seen)
    message = F.concat(F.lit(o.open_turn), visitor.guarded(F.col("role"), o.close_role.rstrip()), F.lit(o.close_role), F.array_join(F.transform("seen", lambda s: s["v"]["shown"]), ""), F.lit(o.close_turn))
    kept = F.transform(F.filter("seen", lambda s: s["kind"].isin(*ATTACHED)), lambda s: F.struct(s["n"].alias("n"), s["kind"].alias("kind"), s["ref"].alias("ref"), s["v"]["tokens"].alias("tokens")))
    tokens = F.aggregate("seen", F.lit(0).cast("long"), lambda a, s: a + s["v"]["tokens"])
    rows = told.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", message.alias("message"), kept.alias("kept")))).alias("m"), F.count("*").alias("n_messages"), F.sum(tokens).alias("n_tokens"))
    found = F.flatten(F.transform("m", lambda x: x["kept"]))
    return rows.select("conv_id", F.array_join(F.transform("m", lambda x: x["message"]), "").alias("formatted"), "n_messages", F.size(found).cast("long").alias("n_attachments"), F.to_json(found).alias("attachments"), "n_tokens")


#: The same for conversations of plain text, which is all that the test tables have.
SQL = r"""
SELECT conv_id,
       string_agg('<|' || regexp_replace(regexp_replace(coalesce(role, 'unknown'), '<(\\*(?:\||image_|audio_|document_))', '<\\\1', 'g'), '\|(\\*>)', '|\\\1', 'g')
                  || '|>' || chr(10) || regexp_replace(coalesce(text, ''), '<(\\*(?:\||image_|audio_|document_))', '<\\\1', 'g') || '<|end|>' || chr(10), ''
                  ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), text NULLS FIRST) AS formatted,
       CAST(count(*) AS BIGINT) AS n_messages,
       CAST(0 AS BIGINT) AS n_attachments,
       '[]' AS attachments,
       CAST(sum((strlen(coalesce(text, '')) + 3) // 4) AS BIGINT) AS n_tokens
FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
"""
