r"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted, adjacent turns of one
role are merged by an array aggregation, and the blocks are concatenated:

    <s>[INST]role[/INST]text[SEP]text</s><s>[INST]role[/INST]text</s>

``[SEP]`` stands between merged turns, so each turn can be read back.  Inside
roles and texts a backslash follows every ``<``, ``[`` and ``\`` of the
original, so no control string can occur there; reading back drops the second character
of each such pair from left to right.  The loss mask is an array of
(start, length) spans of the formatted string, in code points: the assistant's
texts, without marks.

A conversation becomes one string, so its turns meet in one row by nature;
conversations are dealt by id and none waits for another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's marks.
OPEN, HEAD, SEP, CLOSE = "<s>[INST]", "[/INST]", "[SEP]", "</s>"
_LITERAL = {HEAD: r"\[/INST\]", SEP: r"\[SEP\]", CLOSE: r"</s>"}
TRAINED = "assistant"
#: Turns of a conversation that are placed, or read back, together.
PART = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def _parts(items: Column) -> Column:
    """An array in slices of ``PART``: a running sum that is kept in slices costs PART for an item, not the whole array."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PART).cast("int")), lambda k: F.slice(items, k * PART + 1, F.lit(PART)))


def format_chat(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """``(conv_id, formatted, loss_spans)``, one row per conversation.

    ``turns``: conv_id, turn, role, text.  Turns are sorted by (turn, role,
    text), nulls first, so ties have one order; repeated rows are turns of their own.  A null
    text or role counts as empty.  Rows with a null conv_id form one
    conversation.  No rows give no rows.
    """
    blank = F.lit("")
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"),
                   F.coalesce(F.col("text").cast("string"), blank).alias("text"))
    conv = (turns.select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t")).groupBy("conv_id")
            .agg(F.sort_array(F.collect_list("t")).alias("ts")))
    # runs of one role: a turn opens a block when its role differs from the turn before
    first = F.filter(F.sequence(F.lit(0), F.size("ts") - 1),
                     lambda i: (i == 0) | (F.col("ts")[i]["role"] != F.get(F.col("ts"), i - 1)["role"]))
    blocks = F.transform("firsts", lambda lo, k: F.struct(
        F.col("ts")[lo]["role"].alias("role"),
        F.transform(F.slice(F.col("ts"), lo + 1, F.coalesce(F.get(F.col("firsts"), k + 1), F.size("ts")) - lo),
                    lambda t: escape(t["text"])).alias("texts")))
    piece = F.transform("blocks", lambda b: F.concat(
        F.lit(OPEN), escape(b["role"]), F.lit(HEAD), F.array_join(b["texts"], SEP), F.lit(CLOSE)))
    # of every turn: what stands between the text before and its own, and how long it is
    head = len(OPEN) + len(HEAD)
    cells = F.flatten(F.transform("blocks", lambda b, k: F.transform(b["texts"], lambda x, j: F.struct(
        F.when(j > 0, len(SEP)).otherwise(F.when(k > 0, len(CLOSE)).otherwise(0) + head + F.length(escape(b["role"]))).cast("long").alias("lead"),
        F.length(x).cast("long").alias("length"), b["role"].alias("role")))))
    empty = F.array().cast("array<struct<start:long,length:long,role:string>>")

    def place(acc, c):
        start = acc["at"] + c["lead"]
        return F.struct((start + c["length"]).alias("at"),
                        F.concat(acc["spans"], F.array(F.struct(start.alias("start"), c["length"].alias("length"), c["role"].alias("role")))).alias("spans"))

    def place_part(acc, part):
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), empty.alias("spans")), place)
        return F.struct(inner["at"].alias("at"), F.concat(acc["spans"], F.array(inner["spans"])).alias("spans"))

    spans = F.flatten(F.aggregate(_parts(F.col("cells")), F.struct(F.lit(0).cast("long").alias("at"), F.array(empty).alias("spans")), place_part)["spans"])
    return (conv.withColumn("firsts", first).withColumn("blocks", blocks).withColumn("cells", cells)
            .select("conv_id", F.array_join(piece, "").alias("formatted"),
                    F.transform(F.filter(spans, lambda s: s["role"] == F.lit(trained)),
                                lambda s: F.struct(s["start"], s["length"])).alias("loss_spans")))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), the turns of a formatted string in order."""
    blocks = F.filter(F.split(formatted, _LITERAL[CLOSE], -1), lambda b: b != "")
    parts = F.transform(blocks, lambda b: F.split(F.substr(b, F.lit(len(OPEN) + 1)), _LITERAL[HEAD], -1))
    return F.flatten(F.transform(parts, lambda p: F.transform(
        F.split(p[1], _LITERAL[SEP], -1), lambda x: F.struct(unescape(p[0]).alias("role"), unescape(x).alias("text")))))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped.

    ``PART`` spans are read out of the stretch of the string that they lie in, as finding a place in a string takes as long as it
    is far from its beginning.
    """
    def read(part):
        first = F.get(part, F.lit(0))["start"]
        last = F.element_at(part, -1)
        stretch = F.substr(formatted, (first + 1).cast("int"), (last["start"] + last["length"] - first).cast("int"))
        return F.transform(F.array(F.struct(stretch.alias("text"), part.alias("spans"))), lambda x: F.array_join(F.transform(
            x["spans"], lambda s: unescape(F.substr(x["text"], (s["start"] - first + 1).cast("int"), s["length"].cast("int")))), ""))[0]
    return F.when(F.size(spans) > 0, F.array_join(F.transform(_parts(spans), read), "")).otherwise(F.lit(""))


def digests(chats: DataFrame) -> DataFrame:
    """Digest columns read back from the formatted strings and their masks."""
    turns = F.array_join(F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (chats.withColumn("turns", read_turns(F.col("formatted")))
            .withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars")))
