"""Chat formatting into budgeted windows with a loss mask.

Turns of a conversation are numbered and their tokens summed up; the prefix sum alone says
which window a turn opens in, so no turn waits for an earlier one:

* the system turn that opens a conversation is repeated at the head of every window that has
  room for it beside the window's own turns; one that fills the budget alone is a turn like others;
* what it leaves of the budget is shared: ``history`` tokens, but no more than half, are kept for
  repeated turns, the rest is the ``stride``.  Window ``2k`` takes the turns that begin in
  ``[k * stride, (k+1) * stride)`` and also end there; a turn that runs over that border makes
  window ``2k+1`` alone.  So windows hold whole turns, and none is longer than the budget
  unless one turn of it is;
* up to ``history_turns`` turns before a window's first are repeated, as far as they fit in
  the history's tokens and in what the window leaves of the budget;
* the loss mask covers the texts of assistant turns where they are new; repeated ones are
  masked, so each is learnt once.

Tokens are counted by ``tokens``, a column function of the text; the default is an estimate from
bytes, as no vocabulary is at hand on the JVM's side.

Template: ``<turn ROLE>\\n`` + text + ``</turn>\\n``.  In texts every ``<turn`` or ``</turn``,
with any number of backslashes after its ``<``, gets one backslash more there; in roles
``%<>`` and line ends become %xx.  Both are undone by ``parse``.

Numbering is done in two levels, runs of ``RUN`` turn numbers and then the sums of the runs, so
that a conversation with a third of all rows is dealt over many tasks.  A turn knows from its own
run, and from the first turns of the next ones, which later windows repeat it.  So texts are
shuffled twice: by run to number them, by window to join them.  The system turn's text is dealt
to windows in groups of ``SPREAD`` of them.

Nulls: null role or
text is empty, rows of null conv_id form one conversation.  Ties in ``turn`` are ordered by
role, then text; repeated rows are turns of their own.  Empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, written

RUN = 512
SPREAD = 256
END = "</turn>\n"


def token_count(text: Column) -> Column:
    """An estimate that needs no vocabulary: four bytes a token, four tokens for the marks."""
    return (F.lit(4) + F.floor((F.octet_length(text) + 3) / 4)).cast("long")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", "<$1$2")


_ROLE = (("%", "%25"), ("<", "%3C"), (">", "%3E"), ("\n", "%0A"))


def escape_role(role: Column) -> Column:
    for a, b in _ROLE:
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescape_role(role: Column) -> Column:
    for a, b in reversed(_ROLE):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def numbered(conversations: DataFrame, ahead: int = 2, tokens=token_count) -> DataFrame:
    """conv, conv_id, idx (turn's place from 0), before (tokens of earlier turns), tokens, role, text, sys_tokens, all_tokens, later.

    ``sys_tokens`` are those of the system turn that opens the conversation (null without one),
    ``all_tokens`` those of the conversation and ``later`` those of up to ``ahead`` next turns.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", tokens(F.col("text"))).withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    rows = rows.withColumn("run", F.coalesce(F.floor(F.col("turn") / RUN), F.lit(-(1 << 62))))
    own = Window.partitionBy("conv", "run").orderBy("turn", "role", "text")
    next_ = F.collect_list("tokens").over(own.rowsBetween(1, ahead)) if ahead else F.array().cast("array<long>")
    rows = rows.withColumn("_n", F.row_number().over(own) - 1).withColumn("_t", F.sum("tokens").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")).withColumn("_next", next_)
    first = F.col("_n") == 0
    runs = rows.groupBy("conv", "run").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("tokens").alias("t"),
        F.max(F.when(first & (F.col("role") == "system"), F.col("tokens"))).alias("sys"),
        F.max(F.when(first, F.slice(F.concat(F.array("tokens"), "_next"), 1, ahead))).alias("head"),
    )
    order = Window.partitionBy("conv").orderBy("run")
    earlier, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = F.flatten(F.collect_list("head").over(order.rowsBetween(1, ahead))) if ahead else F.array().cast("array<long>")
    runs = runs.select("conv", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("_t0"), F.first("sys").over(whole).alias("sys_tokens"), F.sum("t").over(whole).alias("all_tokens"), heads.alias("_heads"))
    rows = rows.join(runs, ["conv", "run"])
    later = F.slice(F.concat("_next", "_heads"), 1, ahead) if ahead else F.col("_next")
    return rows.select("conv", "conv_id", (F.col("_n") + F.col("_n0")).cast("long").alias("idx"), (F.col("_t") + F.col("_t0")).cast("long").alias("before"), "tokens", "role", "text", "sys_tokens", "all_tokens", later.alias("later"))


def windows(conversations: DataFrame, budget: int = 1024, history: int = 256, history_turns: int = 2, tokens=token_count) -> DataFrame:
    """Formatted windows: conv_id, window, n_context (repeated turns at the head), n_new, formatted, loss_spans.

    ``loss_spans`` are (start, length) in code points of ``formatted``; the text there is escaped.
    """
    turns = numbered(conversations, history_turns, tokens)
    system = F.coalesce(F.when(F.col("sys_tokens") < budget, F.col("sys_tokens")), F.lit(0))  # 0: nothing to repeat
    room = F.lit(budget) - system
    turns = turns.withColumn("sys", system.cast("long")).withColumn("past", F.least(F.lit(history), F.floor(room / 2)).cast("long")).withColumn("stride", (room - F.col("past")).cast("long"))
    opens = (F.col("idx") == 0) & (F.col("sys") > 0)

    def placed(before: Column, size: Column) -> Column:
        """Window of a turn, and what its own turns may take of the budget beside the system turn."""
        after = F.greatest(before - F.col("sys"), F.lit(0))  # the system turn itself takes no stride
        k = F.floor(after / F.col("stride"))
        over = after + size > (k + 1) * F.col("stride")
        return F.struct((2 * k + over.cast("long")).alias("window"), F.when(over, size).otherwise(F.col("stride")).alias("own"))

    def repeats() -> Column:
        """The later windows that repeat this turn."""
        ends = F.transform("later", lambda t, i: F.aggregate(F.slice(F.col("later"), F.lit(1), i), F.col("before") + F.col("tokens"), lambda acc, x: acc + x))
        places = lambda end: F.concat(F.array(F.col("place")), F.transform("later", lambda t, i: placed(F.get(end, i), t)))
        fits = lambda end, all_, i: (all_[i]["window"] != all_[i + 1]["window"]) & (F.get(end, i) - F.col("before") <= F.least(F.col("past"), F.lit(budget) - F.col("sys") - all_[i + 1]["own"]))
        n = lambda all_: F.sequence(F.lit(0), F.size(all_) - 2)
        chosen = lambda end, all_: F.transform(F.filter(n(all_), lambda i: fits(end, all_, i)), lambda i: all_[i + 1]["window"])
        found = let(ends, lambda end: let(places(end), lambda all_: chosen(end, all_)))
        return F.when((F.size("later") > 0) & ~opens, found).otherwise(F.array().cast("array<long>"))

    turns = written(turns.withColumn("place", placed(F.col("before"), F.when(opens, 0).otherwise(F.col("tokens")))).withColumn("repeats", repeats()))
    target = F.explode(F.concat(F.array(F.struct(F.col("place.window").alias("window"), F.lit(2).alias("kind"))), F.transform("repeats", lambda w: F.struct(w.alias("window"), F.lit(1).alias("kind"))))).alias("t")
    pieces = turns.select("conv", "idx", "role", "text", target).select("conv", "t.window", "idx", "role", "text", "t.kind")
    # windows that have room for the system turn, and the turn for every SPREAD of them
    group = F.floor(F.col("window") / SPREAD)
    asking = turns.where((F.col("sys") > 0) & (F.col("idx") > 0) & (F.col("place.window") > 0) & (F.col("sys") + F.col("place.own") <= budget)).select("conv", "place.window").distinct().withColumn("_group", group)
    last = F.floor(2 * (F.floor(F.col("all_tokens") / F.col("stride")) + 1) / SPREAD)
    given = turns.where(opens).select(F.col("conv").alias("_conv"), "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_part"))
    heads = asking.join(given, (F.col("conv") == F.col("_conv")) & (F.col("_group") == F.col("_part"))).select("conv", "window", F.lit(0).cast("long").alias("idx"), F.lit("system").alias("role"), "text", F.lit(0).alias("kind"))
    pieces = pieces.unionByName(heads)

    grouped = pieces.groupBy("conv", "window").agg(F.array_sort(F.collect_list(F.struct("kind", "idx", "role", "text"))).alias("turns"))
    marked = F.transform("turns", lambda t: F.struct((t["kind"] < 2).alias("old"), (t["role"] == "assistant").alias("target"), F.concat(F.lit("<turn "), escape_role(t["role"]), F.lit(">\n")).alias("head"), escape(t["text"]).alias("body")))
    grouped = grouped.select("conv", "window", marked.alias("turns"))
    none = F.array().cast("array<struct<start:long,length:long>>")

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["head"])
        span = F.struct(start.cast("long").alias("start"), F.length(t["body"]).cast("long").alias("length"))
        spans = F.when(t["target"] & ~t["old"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((start + F.length(t["body"]) + len(END)).cast("long").alias("at"), spans.alias("spans"))

    loss = F.aggregate("turns", F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    old = F.size(F.filter("turns", lambda t: t["old"]))
    return grouped.select(
        F.when(F.col("conv") != "", F.col("conv")).cast(conversations.schema["conv_id"].dataType).alias("conv_id"),
        "window",
        old.cast("long").alias("n_context"),
        (F.size("turns") - old).cast("long").alias("n_new"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        loss.alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted window, unescaped: array of (role, text)."""
    parts = F.split(formatted, END, -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        role = F.regexp_extract(part, "^<turn ([^>]*)>\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(part, F.length(role) + 9, F.length(part))).alias("text"))

    return F.transform(parts, turn)


def under_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
