"""Chat formatting with Spark expressions only: no Python runs on the executors.

The turns of a conversation are put in order by a window, which also tells where the role changes and how much text stands
before each turn; then they are collected as structs, sorted, and concatenated, adjacent turns of one role as one block. The output is
one text and the spans of it that are trained on.

Template, with the texts of merged turns kept apart by a separator so that they can be read back:

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT<|im_end|>\\n

Control strings start with ``<|``. In texts and roles every ``<`` that backslashes and a bar follow gets one more backslash
before the bar, so no text contains ``<|``; reading takes one backslash away. A line end in a role is written as a control
string. A conversation becomes one row, so all its turns meet in one task by nature: it must fit in a Spark value. The work grows
with its text, not with the square of its turns.

Null texts and roles are read back as empty; a null turn sorts first, ties of turns go by role and text; rows with a null
conversation id are one conversation; repeated rows are turns each. An empty table gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEPARATOR, END, LINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<|nl|>"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def _role_out(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE), F.lit("\n")))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         trained: str = TRAINED) -> DataFrame:
    """(conv, formatted, loss_spans): spans (start, length) are code points of ``formatted``, one for each trained turn."""
    said = turns.select(
        F.col(conv).alias(conv),
        F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("_role"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    order = Window.partitionBy(conv).orderBy(F.asc_nulls_first("_turn"), "_role", "_text")
    # A block opens where the role differs from the turn before and ends where it differs from the next.
    opens = F.coalesce(F.lag("_role").over(order) != F.col("_role"), F.lit(True))
    ends = F.coalesce(F.lead("_role").over(order) != F.col("_role"), F.lit(True))
    # Each turn as what stands before its text, the text, and what stands behind it.
    pieces = said.select(
        conv,
        F.row_number().over(order).alias("k"),
        F.when(opens, F.concat(F.lit(START), _role_out(F.col("_role")), F.lit("\n"))).otherwise(F.lit(SEPARATOR)).alias("before"),
        escape(F.col("_text")).alias("text"),
        F.when(ends, F.lit(END)).otherwise(F.lit("")).alias("after"),
        (F.col("_role") == trained).alias("trained"),
    )
    whole = pieces.select(
        conv, "k", "trained", F.concat("before", "text", "after").alias("piece"),
        F.char_length("before").cast("long").alias("lead"), F.char_length("text").cast("long").alias("length"),
    )
    # Where each piece starts: the sum of all lengths before it.
    before = Window.partitionBy(conv).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + F.col("lead")
    placed = whole.withColumn("span", F.struct(start.cast("long").alias("start"), "length"))
    rows = placed.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct("k", "piece", "trained", "span"))).alias("_all"))
    spans = F.transform(F.filter("_all", lambda p: p.getField("trained")), lambda p: p.getField("span"))
    return rows.select(
        conv,
        F.array_join(F.transform("_all", lambda p: p.getField("piece")), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) in a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.char_length(role) + 2)
        body = F.substr(body, F.lit(1), F.char_length(body) - len(END))
        return F.transform(
            F.split(body, r"<\|im_sep\|>"),
            lambda text: F.struct(_role_in(role).alias("role"), unescape(text).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


#: Code points of a stretch that spans are cut from.
STRETCH = 1024


def read_trained(formatted: Column, spans: Column) -> Column:
    """The trained texts, cut out of a formatted conversation by its spans.

    The text is cut into stretches once, and a span from the few stretches it lies in: from the whole text each
    cut would count its characters from the start.
    """
    stretches = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))

    def text(parts: Column, s: Column) -> Column:
        start, length = s.getField("start"), s.getField("length")
        first = F.floor(start / STRETCH)
        count = F.floor((start + length) / STRETCH) - first + 1
        near = F.array_join(F.slice(parts, (first + 1).cast("int"), count.cast("int")), "")
        return unescape(F.substr(near, (start - first * STRETCH + 1).cast("int"), length.cast("int")))

    # A one-element array binds the stretches, which a lambda would else work out for each span.
    return F.flatten(F.transform(F.array(stretches), lambda parts: F.transform(spans, lambda s: text(parts, s))))


