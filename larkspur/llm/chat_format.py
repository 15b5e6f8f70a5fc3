"""Chat formatting in budgeted windows (DataFrame functions only).

The turns of a conversation are cut into windows of at most ``budget`` tokens,
each of which retains the system turn (the first turn of that role, wherever
it stands). What it leaves of the budget is the *room* of the conversation.
Prefix sums of the other turns' tokens place every turn: a grid of ``stride``
tokens, half of the room without the history, is laid over the sums and a turn
belongs to the cell it ends in, so windows are turn-aligned and each turn is
chosen without looking at its neighbours. The turns of a cell that are no
longer than a stride sum to less than two strides. A longer turn gets a window
of its own: only where it and the system turn exceed the budget does a window.
Every other window repeats the turns that begin at most ``history`` tokens (a
quarter of the room, where that is less) before its cell. Only assistant text
in the window that owns it is a target; repeated turns and all other roles are
masked.

The template marks turns by control strings that all begin with ``<`` or
``[``. Inside texts and roles a backslash is put behind every ``<``, ``[`` and
``\\``, so no control string can occur there, and taking those backslashes out
again gives the text.

A conversation may hold a large share of all rows: positions and prefix sums
are made within blocks of turns first and then over blocks, and windows meet
the text of their system turn in ``SALTS`` tasks.

Defined cases: null text or role is empty; null ``conv_id`` is a conversation
of its own; null turns come first; rows that tie on ``turn`` go by role, then
text, and repeated rows are turns of their own; an empty table gives no
windows; of the input only the four named columns are used, so extra columns
cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the template.
TURN, TEXT, END, BEGIN_WINDOW, END_WINDOW = "<s>[", "]\n", "</s>\n", "[INST]\n", "[/INST]\n"
#: Turn numbers that share a block.
BLOCK_TURNS = 64
#: Tasks that the windows of a conversation are spread over when they get its system turn.
SALTS = 16


def escape(text: Column) -> Column:
    """Break every control string: a backslash behind ``<``, ``[`` and ``\\``."""
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def token_estimate(text: Column) -> Column:
    """Tokens of a turn: words, numbers and single signs, and four for the template."""
    return (F.regexp_count(text, F.lit(r"[\p{L}\p{M}]+|\p{N}|[^\s\p{L}\p{M}\p{N}]")) + 4).cast("long")


def _key(conv_id: Column) -> Column:
    """A conversation as a text that is never null."""
    return F.concat(F.when(conv_id.isNull(), "n").otherwise("v"), F.coalesce(conv_id.cast("string"), F.lit("")))


def _turns(turns: DataFrame, tokens: Column | None) -> DataFrame:
    rows = turns.select("conv_id", _key(F.col("conv_id")).alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("tokens", token_estimate(F.col("text")) if tokens is None else tokens)


def placed_turns(turns: DataFrame, tokens: Column | None = None) -> DataFrame:
    """Turns with ``position`` (from 0) and ``before``, the tokens of earlier turns of the conversation.

    ``s_position`` and ``s_tokens`` are those of the system turn, null where there is none.
    """
    rows = _turns(turns, tokens).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 60))))
    order = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("in_block", F.row_number().over(order)).withColumn("sum_block", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("conv")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = F.min(F.when(F.col("role") == "system", F.struct("in_block", "tokens")))
    blocks = rows.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), first.alias("s"))
    blocks = blocks.withColumn("n_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("t_before", F.coalesce(F.sum("t").over(earlier), F.lit(0)))
    system = F.min(F.when(F.col("s").isNotNull(), F.struct((F.col("n_before") + F.col("s.in_block") - 1).alias("position"), F.col("s.tokens").alias("tokens")))).over(whole)
    blocks = blocks.withColumn("s", system).select("conv", "block", "n_before", "t_before", F.col("s.position").alias("s_position"), F.col("s.tokens").alias("s_tokens"))
    return rows.join(blocks, ["conv", "block"]).select(
        "conv",
        "conv_id",
        "role",
        "text",
        "tokens",
        (F.col("n_before") + F.col("in_block") - 1).alias("position"),
        (F.col("t_before") + F.col("sum_block") - F.col("tokens")).alias("before"),
        "s_position",
        "s_tokens",
    )


def windows(turns: DataFrame, budget: int = 1024, history: int = 192, tokens: Column | None = None) -> DataFrame:
    """One row for each window: ``conv_id, window, formatted, segments, n_tokens``.

    ``segments``: role, position, ``begin`` (from 0) and ``length`` of the
    escaped text in ``formatted``, ``owned`` (not repeated) and ``target``.
    """
    placed = placed_turns(turns, tokens)
    is_system = F.coalesce(F.col("position") == F.col("s_position"), F.lit(False))
    room = F.greatest(F.lit(budget) - F.coalesce("s_tokens", F.lit(0)), F.lit(0))
    placed = placed.withColumn("is_system", is_system).withColumn("room", room).withColumn("history", F.least(F.lit(history), F.floor(F.col("room") / 4)))
    placed = placed.withColumn("stride", F.greatest(F.lit(1), F.floor((F.col("room") - F.col("history") + 1) / 2)))
    # the system turn counts nothing in the sums: it is in every window
    placed = placed.withColumn("before", F.col("before") - F.when(F.col("position") > F.col("s_position"), F.col("s_tokens")).otherwise(0))
    end = F.col("before") + F.when(F.col("is_system"), 0).otherwise(F.col("tokens"))
    placed = placed.withColumn("cell", F.greatest(F.lit(0), F.floor((end - 1) / F.col("stride")))).withColumn("wide", ~F.col("is_system") & (F.col("tokens") > F.col("stride")))
    place = lambda window, owned: F.struct(window.alias("window"), F.lit(owned).alias("owned"))
    again = ~F.col("wide") & ~F.col("is_system") & (F.col("before") >= (F.col("cell") + 1) * F.col("stride") - F.col("history"))
    places = F.array(place(F.col("cell") * 2 + F.when(F.col("wide"), 0).otherwise(1), True), F.when(again, place((F.col("cell") + 1) * 2 + 1, False)))
    turn = F.struct("position", "owned", "role", escape(F.col("text")).alias("text"), escape(F.col("role")).alias("mark"), "tokens")
    each = placed.withColumn("place", F.explode(F.array_compact(places))).select("*", "place.*")
    grouped = each.groupBy("conv", "window").agg(
        F.first("conv_id").alias("conv_id"),
        F.sort_array(F.collect_list(turn)).alias("turns"),
        F.min(F.when(F.col("owned"), F.col("position"))).alias("first"),
        F.max("s_position").alias("s_position"),
    )
    grouped = grouped.where(F.col("first").isNotNull())
    # history must reach up to the first own turn without a gap
    repeated = F.filter("turns", lambda t: ~t["owned"])
    joined = F.coalesce(F.array_max(F.transform(repeated, lambda t: t["position"])) == F.col("first") - 1, F.lit(False))
    grouped = grouped.withColumn("turns", F.when(joined, F.col("turns")).otherwise(F.filter("turns", lambda t: t["owned"])))
    # the first system turn in the order of positions, with a row for each salt
    system = _turns(turns, tokens).where("role = 'system'").groupBy("conv").agg(F.min(F.struct("turn", "text", "role", "tokens")).alias("s"))
    system = system.select("conv", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("s.text").alias("s_text"), F.col("s.tokens").alias("s_tokens"))
    grouped = grouped.withColumn("salt", (F.col("window") % SALTS).cast("int")).join(system, ["conv", "salt"], "left")
    copy = F.struct(F.col("s_position").alias("position"), F.lit(False).alias("owned"), F.lit("system").alias("role"), escape(F.col("s_text")).alias("text"), F.lit("system").alias("mark"), F.col("s_tokens").alias("tokens"))
    has_own = F.exists("turns", lambda t: t["position"] == F.col("s_position"))
    turns_of = F.when(F.col("s_position").isNotNull() & ~has_own, F.concat(F.array(copy), F.col("turns"))).otherwise(F.col("turns"))
    pieces = F.transform(turns_of, lambda t: F.concat(F.lit(TURN), t["mark"], F.lit(TEXT), t["text"], F.lit(END)))
    body = F.concat(F.lit(BEGIN_WINDOW), F.array_join("pieces", ""), F.lit(END_WINDOW))
    shaped = grouped.withColumn("turns", turns_of).withColumn("pieces", pieces)
    sizes = F.transform("pieces", lambda p: F.char_length(p).cast("long"))
    start = F.lit(len(BEGIN_WINDOW)).cast("long")
    # begin of each piece: a running sum kept as an array
    begins = F.aggregate(sizes, F.array(start), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    segments = F.transform(
        F.arrays_zip(F.col("turns").alias("t"), F.slice("begins", 1, F.size("turns")).alias("b")),
        lambda z: F.struct(
            z["t"]["role"].alias("role"),
            z["t"]["position"].alias("position"),
            (z["b"] + len(TURN) + F.char_length(z["t"]["mark"]) + len(TEXT)).alias("begin"),
            F.char_length(z["t"]["text"]).cast("long").alias("length"),
            z["t"]["owned"].alias("owned"),
            (z["t"]["owned"] & (z["t"]["role"] == "assistant")).alias("target"),
        ),
    )
    total = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"])
    return shaped.withColumn("begins", begins).select("conv_id", "window", body.alias("formatted"), segments.alias("segments"), total.alias("n_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns read out of the windows: ``conv_id, position, role, text, target``, each turn once.

    ``chars``: the length of the window, with the first turn that it owns; 0 with the others.
    """
    own = F.filter("segments", lambda s: s["owned"])
    each = formatted.select("conv_id", "formatted", F.posexplode(own).alias("nth", "s"))
    return each.select(
        "conv_id",
        "s.position",
        "s.role",
        unescape(F.substr("formatted", (F.col("s.begin") + 1).cast("int"), F.col("s.length").cast("int"))).alias("text"),
        "s.target",
        F.when(F.col("nth") == 0, F.char_length("formatted")).otherwise(0).cast("long").alias("chars"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, from its windows alone.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.
    Turns are joined within blocks first, so only block texts meet.
    """
    turns = read_back(formatted).withColumn("block", F.floor(F.col("position") / BLOCK_TURNS))
    line = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    in_order = lambda c: F.array_join(F.transform(F.sort_array(c), lambda x: x["text"]), "")
    part = F.struct("position", line.alias("text"))
    loss = F.struct("position", F.when(F.col("target"), F.col("text")).otherwise("").alias("text"))
    blocks = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), in_order(F.collect_list(part)).alias("lines"), in_order(F.collect_list(loss)).alias("loss"))
    joined = blocks.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        in_order(F.collect_list(F.struct("block", F.col("lines").alias("text")))).alias("lines"),
        in_order(F.collect_list(F.struct("block", F.col("loss").alias("text")))).alias("loss"),
    )
    return joined.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("lines").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_control_strings(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose two turns consist of control strings."""
    text = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))).alias("t"))
    more = more.select(F.lit(-1).cast("long").alias("conv_id"), F.col("t.turn").cast("long").alias("turn"), "t.role", F.lit(text).alias("text"))
    own = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return own.unionByName(more)
