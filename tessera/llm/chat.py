"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are the
context, and the reply's text alone is trainable. A turn is written as

    ### role: text</turn>\\n

Inside texts and roles the characters that control strings are made of are
escaped, and so is the escape itself: ``\\`` to ``\\b``, ``<`` to ``\\l``, ``#`` to
``\\h``, ``:`` of a role to ``\\c``. So ``<`` and ``#`` stand in control strings only,
and reading back is exact for any text.

Turns after a conversation's last reply (or all, if it has none) make one more
example without trainable text, so that the output holds every turn. An example
is the whole prefix, as the method wants it: a conversation must fit one row.

Nulls and edge cases: a null text or role is empty. Turns are ordered by turn,
then role, then text (null turns first); repeated rows are turns of their own.
Rows with a null conversation id form one conversation. An empty table gives no
examples. Only the four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
ASSISTANT = "assistant"
ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c")]


def escaped(c: Column, pairs=ESCAPES) -> Column:
    for plain, code in pairs:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column, pairs=ESCAPES) -> Column:
    """Each escape is ``\\`` and a letter, and no letter is ``\\``: so the backslash's own code goes last."""
    for plain, code in reversed(pairs):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = ASSISTANT) -> DataFrame:
    """(conv, example, formatted, loss_start, loss_end): one row an assistant turn, in order.

    The mask covers the characters from loss_start up to loss_end, counted in
    code points from 0; it is empty for turns that no reply follows.
    """
    rows = turns.select(
        F.col(conv).alias("_conv"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"),
    )
    whole = rows.groupBy("_conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    head = lambda t: F.concat(F.lit(OPEN), escaped(t["role"], ROLE_ESCAPES), F.lit(AFTER_ROLE))
    written = F.transform(
        "t", lambda t: F.struct(head(t).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == target).alias("reply"))
    )
    # places, from 1, of the turns that end an example: the replies, and the last turn in any case
    places = F.sequence(F.lit(1), F.size("w"))
    ends = F.filter(places, lambda i: F.get(F.col("w"), i - 1)["reply"] | (i == F.size("w")))
    cut = whole.select("_conv", written.alias("w")).select("_conv", "w", F.posexplode(ends).alias("example", "end"))
    last = F.get(F.col("w"), F.col("end") - 1)
    line = lambda w: F.concat(w["head"], w["body"], F.lit(CLOSE))
    context = F.array_join(F.transform(F.slice("w", 1, F.col("end") - 1), line), "")
    made = cut.select("_conv", "example", context.alias("context"), last.alias("last"))
    start = F.length("context") + F.length("last.head")
    return made.select(
        F.col("_conv").alias(conv),
        "example",
        F.concat("context", line(F.col("last"))).alias("formatted"),
        F.when(F.col("last.reply"), start).otherwise(0).alias("loss_start"),
        F.when(F.col("last.reply"), start + F.length("last.body")).otherwise(0).alias("loss_end"),
    )


def turns_of(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted example."""
    lines = F.filter(F.split(formatted, CLOSE), lambda s: F.length(s) > 0)

    def parse(line: Column) -> Column:
        at = F.instr(line, AFTER_ROLE)  # the first ':' ends the role
        role = F.substring(line, F.lit(len(OPEN) + 1), at - F.lit(len(OPEN) + 1))
        return F.struct(unescaped(role, ROLE_ESCAPES).alias("role"), unescaped(F.substring(line, at + F.lit(len(AFTER_ROLE)), F.length(line))).alias("text"))

    return F.transform(lines, parse)


def trainable(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the mask, unescaped."""
    return unescaped(F.substring(formatted, start + 1, end - start))
