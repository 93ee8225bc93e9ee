"""Chat formatting: every assistant turn becomes an example of its own, with all turns before it as context and only its reply trainable.

A turn is written ``begin role middle text end``. Control strings inside a role or a text are escaped: a backslash goes behind the first
character of each, and behind that of each that already has backslashes there. So no control string is left in a text, and taking one
backslash out of every such place gives the text back. First characters occur nowhere else in a control string, hence places never overlap.

Everything is DataFrame and column functions. A conversation is one string in the end (its digest and its longest example both need
it), so its turns meet in one task, sorted by a window that spills. Its examples repeat their context, so their length grows with the square
of the turns: that is the method. The examples of a conversation with many replies are dealt to tasks in blocks of ``BLOCK``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roundhouse.llm.shared import Scratch

#: replies of one conversation that one task expands
BLOCK = 64


@dataclass(frozen=True)
class Template:
    """Marks of a turn and the control strings that no text may hold. The defaults are fixed values of public chat formats."""

    begin: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    controls: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<SYS>>", "</SYS>>")
    trainable: str = "assistant"

    def __post_init__(self) -> None:
        every = (self.begin, self.middle, self.end, *self.controls)
        firsts = {c[:1] for c in every}
        if "" in firsts or any("\\" in c or firsts & set(c[1:]) for c in every):
            raise ValueError("a control string has a first character that none has further on, and no backslash")

    def by_first(self) -> dict[str, str]:
        """For each first character, a pattern of what may follow it."""
        every = dict.fromkeys((self.begin, self.middle, self.end, *self.controls))
        return {first: "|".join(re.escape(c[1:]) for c in every if c[0] == first) for first in dict.fromkeys(c[0] for c in every)}


def escaped(text: Column, template: Template) -> Column:
    for first, rest in template.by_first().items():
        text = F.regexp_replace(text, F.lit(f"{re.escape(first)}(\\\\*)(?={rest})"), F.lit(f"{first}\\\\$1"))
    return text


def unescaped(text: Column, template: Template) -> Column:
    for first, rest in template.by_first().items():
        text = F.regexp_replace(text, F.lit(f"{re.escape(first)}\\\\(\\\\*)(?={rest})"), F.lit(f"{first}$1"))
    return text


def transcripts(rows: DataFrame, template: Template) -> DataFrame:
    """``conv_id, transcript, examples`` a conversation: where each example ends, and where its reply begins and how long it is.

    The last example holds all turns: if the last turn is no reply, one without a trainable part is added, so no turn is lost.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    head = F.concat(F.lit(template.begin), escaped(F.col("role"), template), F.lit(template.middle))
    turns = rows.withColumn("head", head).withColumn("body", escaped(F.col("text"), template))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(template.end)))
    turns = turns.withColumn("place", F.row_number().over(order)).withColumn("end", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.length("body").cast("bigint")
    part = F.struct("place", "piece", "end", (F.col("end") - len(template.end) - length).alias("start"), length.alias("length"), (F.col("role") == template.trainable).alias("reply"))
    told = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("turns"))
    last = F.element_at("turns", -1)
    none = F.lit(0).cast("bigint")
    replies = F.transform(
        F.filter("turns", lambda t: t["reply"]),
        lambda t: F.struct(t["end"].alias("end"), t["start"].alias("start"), t["length"].alias("length"), (t["place"] == last["place"]).alias("last")),
    )
    rest = F.array(F.struct(last["end"].alias("end"), last["end"].alias("start"), none.alias("length"), F.lit(True).alias("last")))
    examples = F.when(last["reply"], replies).otherwise(F.concat(replies, rest))
    return told.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("transcript"), examples.alias("examples"))


def examples(conversations: DataFrame, template: Template = Template(), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, example, text, loss_start, loss_length, last``: one row for each assistant turn, in order from 0.

    ``text`` holds all turns up to the reply; ``loss_start`` and ``loss_length`` (code points) mark the reply's text, all that is trainable.
    A conversation that doesn't end with a reply has one more row with all its turns and ``loss_length`` 0. ``last`` marks the row with all turns.
    Null roles and texts are empty. Turns go by number, null first, then by role and text; rows that repeat are turns of their own. Rows
    without a conversation id are one conversation without id. An empty table gives no rows. Other columns are left out.
    """
    scratch = Scratch(conversations.sparkSession, "chat")
    rows = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    told = scratch.save(transcripts(rows, template))
    few = told.where(F.size("examples") <= BLOCK).withColumn("first", F.lit(0))
    many = told.where(F.size("examples") > BLOCK).withColumn("first", F.explode(F.sequence(F.lit(0), F.size("examples") - 1, F.lit(BLOCK))))
    many = many.withColumn("examples", F.slice("examples", F.col("first") + 1, F.lit(BLOCK))).repartition("conv_id", "first")
    one = few.unionByName(many).select("conv_id", "transcript", "first", F.posexplode("examples").alias("k", "e"))
    text = F.substring(F.col("transcript"), F.lit(1), F.col("e.end").cast("int"))
    return one.select(
        "conv_id", (F.col("first") + F.col("k")).cast("bigint").alias("example"), text.alias("text"), F.col("e.start").alias("loss_start"), F.col("e.length").alias("loss_length"), F.col("e.last").alias("last")
    )


def turns_of(text: Column, template: Template) -> Column:
    """Turns ``role, text`` of a formatted text."""
    pieces = F.split(text, f"\\Q{template.end}\\E", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        parts = F.split(F.substring(piece, F.lit(len(template.begin) + 1), F.length(piece)), f"\\Q{template.middle}\\E", -1)
        return F.struct(unescaped(parts[0], template).alias("role"), unescaped(parts[1], template).alias("text"))

    return F.transform(pieces, turn)


def read_back(found: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of what ``examples`` made, from its texts and masks alone: a row a conversation.

    ``turns_sha256`` is of role, newline, text, newline of every turn of the last example; ``loss_sha256`` of all trainable text in order;
    ``formatted_chars`` counts the code points of all examples, contexts included.
    """
    loss = F.substring(F.col("text"), (F.col("loss_start") + 1).cast("int"), F.col("loss_length").cast("int"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    rows = found.select("conv_id", "example", F.length("text").cast("bigint").alias("chars"), unescaped(loss, template).alias("loss"), F.when(F.col("last"), turns_of(F.col("text"), template)).alias("turns"))
    rows = rows.select("conv_id", "chars", F.struct("example", "loss").alias("part"), F.size("turns").cast("bigint").alias("n"), F.when(F.col("turns").isNotNull(), F.sha2(F.array_join(lines, ""), 256)).alias("digest"))
    told = rows.groupBy("conv_id").agg(F.max("n").alias("n_turns"), F.max("digest").alias("turns_sha256"), F.sort_array(F.collect_list("part")).alias("parts"), F.sum("chars").alias("formatted_chars"))
    told = told.withColumn("loss", F.array_join(F.transform("parts", lambda p: p["loss"]), ""))
    return told.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
