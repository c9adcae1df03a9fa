"""Chat formatting into token-budgeted windows, with DataFrame functions only.

Running sums of turn tokens cut a conversation's turns into spans: a span takes turns as
long as the budget allows.  A window is one span, preceded by the system turn and by as
much of the history before it as the history budget allows; prefix sums tell how far that
reaches.  Only a window's own assistant turns carry loss, so every
assistant text is a target exactly once however often it is repeated as history.

A turn is written ``<|turn|>role\\ntext<|end|>\\n``.  Control strings inside roles and texts,
this template's and those of other common ones, are broken by an escape that can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tokens of a window, and of the history repeated before it.
BUDGET, HISTORY = 1024, 256
#: Tokens that a turn's marks count for.
MARKS = 4

TURN, END = "<|turn|>", "<|end|>\n"
# What opens control strings of this and other templates.
_CONTROL = r"([<\[])(?=\||/?s>|</?SYS>>|/?INST\])"
#: Words and single signs: an estimate of tokens, since tokenizers are no DataFrame functions.
_TOKEN = r"[\p{L}\p{N}\p{M}]+|[^\s\p{L}\p{N}\p{M}]"


def escape(text: Column) -> Column:
    """Backslashes become ``\\b``; control strings get ``\\p`` after their first character."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\b")), _CONTROL, r"$1\\p")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("")), F.lit("\\b"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\l"))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\p"), F.lit("")), F.lit("\\l"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def tokens(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(_TOKEN)) + MARKS).cast("long")


def windows(conversations: DataFrame, *, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Per window: conv_id, window, text, loss_spans, n_repeated, n_turns, n_tokens.

    conversations: conv_id, turn, role, text; turns in the order of turn, then role, then
    text.  loss_spans: array<struct<start, end>> of code points of text, 0-based; n_repeated:
    how many turns at the start of text repeat earlier ones (system turn and history);
    n_turns: the window's own turns.  A window holds at most ``budget`` tokens unless one
    turn alone, or the system turn, exceeds it.  A first turn of role system is repeated in every later
    window.  The sizes of a conversation's turns, not their texts, meet in one row.  Null
    roles and texts are empty; a null conv_id is a conversation of its own;
    other columns are ignored; an empty table gives an empty result.
    """
    turns = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("size", tokens(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.select("*", F.row_number().over(order).alias("at"), F.sum("size").over(upto).alias("stop"), F.first(F.struct("role", "text", "size")).over(upto).alias("opening"))
    has_system = F.col("opening.role") == "system"
    room = F.greatest(F.lit(budget - history) - F.when(has_system, F.col("opening.size")).otherwise(0), F.lit(max(1, budget // 4)))
    # the system turn has its own place, so prefix sums run over the others
    first = F.when(has_system, F.col("opening.size")).otherwise(0)
    turns = turns.withColumn("is_system", has_system & (F.col("at") == 1)).withColumn("start", F.col("stop") - F.col("size") - first).withColumn("stop", F.col("stop") - first)
    # a span is closed by the first turn that does not fit; only sizes meet in one row
    sizes = turns.filter(~F.col("is_system")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "size"))).alias("sizes"), F.first(room).alias("room"))

    def taken(state: Column, turn: Column) -> Column:
        closed = (state["used"] > 0) & (state["used"] + turn["size"] > F.col("room"))
        used = F.when(closed, turn["size"]).otherwise(state["used"] + turn["size"])
        return F.struct(used.alias("used"), F.when(closed, F.concat(state["starts"], F.array(turn["at"]))).otherwise(state["starts"]).alias("starts"))

    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array(F.col("sizes")[0]["at"]).alias("starts"))
    spans = sizes.select("conv_id", F.aggregate("sizes", empty, taken, lambda state: state["starts"]).alias("starts"), F.element_at("sizes", -1)["at"].alias("last"))
    stops = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.col("last") + 1))
    spans = spans.select("conv_id", F.posexplode(F.arrays_zip(F.col("starts").alias("from"), stops.alias("to"))).alias("window", "span"))
    spans = spans.select(F.col("conv_id").alias("of"), F.col("window").cast("long").alias("window"), F.explode(F.sequence(F.col("span.from"), F.col("span.to") - 1)).alias("place"))
    turns = turns.join(spans, turns["conv_id"].eqNullSafe(spans["of"]) & (turns["at"] == spans["place"]), "left").drop("of", "place")
    turns = turns.withColumn("window", F.coalesce("window", F.lit(0).cast("long")))
    turns = turns.withColumn("opens", ~F.col("is_system") & (F.lag("window", 1, -1).over(order) != F.col("window")) | F.col("is_system") | (F.lag("is_system", 1, False).over(order) & (F.col("window") > 0)))
    ahead = Window.partitionBy("conv_id").orderBy("start").rangeBetween(1, history)
    turns = turns.withColumn("later", F.when(~F.col("is_system"), F.collect_list(F.when(F.col("opens") & ~F.col("is_system"), F.col("window"))).over(ahead)))

    own = turns.select("conv_id", "window", F.lit(2).alias("part"), "at", "role", "text", "size", F.lit(False).alias("repeated"))
    before = turns.select("conv_id", F.explode("later").alias("window"), F.lit(1).alias("part"), "at", "role", "text", "size", F.lit(True).alias("repeated"))
    system = turns.filter(F.col("opens") & (F.col("window") > 0) & has_system).select(
        "conv_id", "window", F.lit(0).alias("part"), F.lit(1).alias("at"), F.col("opening.role").alias("role"), F.col("opening.text").alias("text"), F.col("opening.size").alias("size"), F.lit(True).alias("repeated")
    )
    rows = own.unionByName(before).unionByName(system)
    rows = rows.withColumn("head", F.concat(F.lit(TURN), _escape_role(F.col("role")), F.lit("\n"))).withColumn("body", escape(F.col("text")))
    rows = rows.withColumn("chars", F.length("head") + F.length("body") + len(END))
    inside = Window.partitionBy("conv_id", "window").orderBy("part", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begin = F.sum("chars").over(inside) - F.col("chars") + F.length("head")
    loss = F.when((F.col("role") == "assistant") & ~F.col("repeated"), F.struct(begin.cast("long").alias("start"), (begin + F.length("body")).cast("long").alias("end")))
    rows = rows.select("conv_id", "window", "part", "at", "size", "repeated", F.concat("head", "body", F.lit(END)).alias("piece"), loss.alias("loss"))
    pieces = F.sort_array(F.collect_list(F.struct("part", "at", "piece", "loss")))
    grouped = rows.groupBy("conv_id", "window").agg(
        pieces.alias("pieces"), F.count_if("repeated").alias("n_repeated"), F.count_if(~F.col("repeated")).alias("n_turns"), F.sum("size").alias("n_tokens")
    )
    return grouped.select(
        "conv_id",
        "window",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text"),
        F.filter(F.transform("pieces", lambda p: p["loss"]), lambda s: s.isNotNull()).alias("loss_spans"),
        "n_repeated",
        "n_turns",
        "n_tokens",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the windows' texts and spans alone: conv_id, turns (array of struct<role, text>), targets (array of string), formatted_chars."""
    pieces = F.slice(F.split("text", r"<\|turn\|>", -1), F.col("n_repeated").cast("int") + 2, F.col("n_turns").cast("int"))

    def turn(piece: Column) -> Column:
        line = F.locate("\n", piece)
        return F.struct(
            _unescape_role(F.substring(piece, F.lit(1), line - 1)).alias("role"), unescape(F.substring(piece, line + 1, F.length(piece) - line - len(END))).alias("text")
        )

    def target(span: Column) -> Column:
        return unescape(F.substring(F.col("text"), (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int")))

    parsed = formatted.select("conv_id", "window", F.transform(pieces, turn).alias("turns"), F.transform("loss_spans", target).alias("targets"), F.length("text").cast("long").alias("chars"))
    ordered = F.sort_array(F.collect_list(F.struct("window", "turns", "targets")))
    grouped = parsed.groupBy("conv_id").agg(ordered.alias("windows"), F.sum("chars").alias("formatted_chars"))
    return grouped.select("conv_id", F.flatten("windows.turns").alias("turns"), F.flatten("windows.targets").alias("targets"), "formatted_chars")


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of conversations read back."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("targets", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """conversations and one more, numbered -1, whose texts are control strings of another template."""
    text = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
