"""Conversations formatted for training by Spark expressions alone (operator 11).

The turns of a conversation are collected as structs and sorted; neighbours of one role are merged into a block of
parts; blocks are written between marks of the template. Texts and names of roles are escaped, so that no mark is ever
found inside them, and :func:`read_turns` gets every turn back from the formatted text. The loss mask is kept over the
segments whose texts joined are the formatted text: it covers what the assistant says, without marks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a block: ``begin``, a head for its role, parts joined by ``part``, ``end``. A role without a head of its
    own is named between ``role`` marks. Marks begin with < or [, hold no other < [ or \\, and none is part of another."""

    begin: str = "<s>"
    end: str = "</s>"
    part: str = "[SEP]"
    role: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    heads: dict[str, str] = field(default_factory=lambda: {"user": "[INST]", "assistant": "[/INST]"})
    learnt: tuple[str, ...] = ("assistant",)

    @property
    def tails(self) -> str:
        """A pattern of what follows the first character of each mark."""
        marks = [self.begin, self.end, self.part, *self.role, *self.heads.values()]
        return "|".join(sorted({r"\Q" + m[1:] + r"\E" for m in marks}))

    def escape(self, text: Column) -> Column:
        """One backslash more between the first character of a mark and its rest: no mark is left, and none is made."""
        return F.regexp_replace(text, rf"([<\[]\\*+)(?={self.tails})", r"$1\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[]\\*)\\(?={self.tails})", "$1")

    def head(self, role: Column) -> Column:
        named = F.concat(F.lit(self.role[0]), self.escape(role), F.lit(self.role[1]))
        out = F.when(F.lit(False), named)
        for name, mark in self.heads.items():
            out = out.when(role == name, F.lit(mark))
        return F.concat(F.lit(self.begin), out.otherwise(named))


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def _segment(text: Column | str, loss: Column | bool) -> Column:
    return F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), (F.lit(loss) if isinstance(loss, bool) else loss).alias("loss"))


def format_conversations(turns: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_blocks, segments (array of text, loss), formatted (their texts joined).

    Turns are sorted by (turn, role, text), a null turn first, so ties and repeated rows keep a fixed order and all stay;
    a null text or role is an empty one, and rows with a null conversation are one conversation. Columns other than the
    four named are left out, whatever their names. An empty table gives an empty table. A conversation is one row, so it
    must fit in memory and in 2 GB once formatted.
    """
    t = template or Template()
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    of = turns.select(F.col(conv).alias("conv_id"), row.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    at = F.sequence(F.lit(0), F.size("turns") - 1)
    begins = F.filter(at, lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    of = of.withColumn("begins", begins)
    # a block: the run of turns from one beginning to the next
    until = lambda k: F.coalesce(F.get("begins", k + 1), F.size("turns"))
    blocks = F.transform("begins", lambda i, k: F.slice("turns", i + 1, until(k) - i))
    of = of.select("conv_id", blocks.alias("blocks"))

    def segments(block: Column) -> Column:
        who = F.get(block, F.lit(0))["role"]
        learnt = who.isin(*t.learnt)
        said = lambda x: _segment(t.escape(x["text"]), learnt)
        parts = F.transform(block, lambda x, i: F.when(i == 0, F.array(said(x))).otherwise(F.array(_segment(t.part, False), said(x))))
        return F.concat(F.array(_segment(t.head(who), False)), F.flatten(parts), F.array(_segment(t.end, False)))

    of = of.select("conv_id", F.size("blocks").alias("n_blocks"), F.flatten(F.transform("blocks", segments)).alias("segments"))
    return of.withColumn("formatted", _joined(F.transform("segments", lambda s: s["text"])))


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    t = template or Template()
    blocks = F.split(formatted, r"\Q" + t.end + r"\E", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)
    begins = {name: t.begin + mark for name, mark in t.heads.items()}
    other = t.begin + t.role[0]

    def parts(block: Column) -> Column:
        role, skip = None, None
        for name, mark in begins.items():
            here = block.startswith(mark)
            role = F.when(here, F.lit(name)) if role is None else role.when(here, F.lit(name))
            skip = F.when(here, F.lit(len(mark))) if skip is None else skip.when(here, F.lit(len(mark)))
        named = F.substring_index(F.substr(block, F.lit(len(other) + 1)), t.role[1], 1)
        if role is None:
            role, skip = named, F.length(named) + len(other) + len(t.role[1])
        else:
            role, skip = role.otherwise(t.unescape(named)), skip.otherwise(F.length(named) + len(other) + len(t.role[1]))
        texts = F.split(F.substr(block, skip + 1), r"\Q" + t.part + r"\E", -1)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), t.unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, parts))


def under_loss(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    t = template or Template()
    return _joined(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: t.unescape(s["text"])))


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Counts and SHA-256 digests of what :func:`format_conversations` wrote, read back from its segments and text."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted"), template).alias("turns"), under_loss(F.col("segments"), template).alias("loss"))
    said = _joined(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
