"""Conversations as training windows of a token budget, in a template that reads back.

A turn costs its role's and text's tokens (up to four characters of a word each)
and ``FRAME`` for its marks. Turns whose running cost ends in the same half of a
budget make a window: prefix sums alone choose the spans, so no turn waits for
another's choice. A window is filled up with what went before it, up to
``HISTORY`` turns while the budget allows; where a system turn went before,
the window begins with it. Turns are never cut: one over the budget is in a
window of its own. Only an assistant's text that is new in a window is under the
loss mask; what is repeated there is masked, so each is learned from once.

Running sums start anew with each block of ``BLOCK`` turn numbers, and a block's
history is read from the last turn numbers before it, so a conversation of any
length is dealt out by blocks. Only where every conversation is shorter than
``LONG`` turns are rows dealt by conversation alone, which saves the later
reader a shuffle and gives the same windows.

In a text, ``<|`` gets another bar, so that ``<`` with one bar is only ever a
mark; reading takes the bar away. A role's line ends are written as a mark.

Defined results: rows of a conversation are ordered by turn (null first), role
and text; rows that repeat are turns of their own. A null role or text is
empty. A null conversation id is a conversation like others, whose rows are
dealt out one by one: by turn and, of equal turns, a hash of role and text. A conversation without an assistant has an
empty loss. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, BLOCK, LONG, FRAME = 2048, 4, 64, 4096, 4
START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|n|>"
TOKEN = r"[^\x20\x09-\x0D]{1,4}"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def _head(role: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit(BREAK)), F.lit("\n"))


def turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, cost, block, tie: nulls filled, with what a turn costs and the block it is dealt to."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    out = rows.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    out = out.withColumn("cost", (F.regexp_count("text", F.lit(TOKEN)) + F.regexp_count("role", F.lit(TOKEN)) + F.lit(FRAME)).cast("long"))
    lone = F.col("conv_id").isNull()
    return out.withColumn("block", F.when(lone, F.coalesce("turn", F.lit(-1))).otherwise(F.floor(F.coalesce("turn", F.lit(0)) / BLOCK))).withColumn("tie", F.when(lone, F.xxhash64("role", "text")).otherwise(F.lit(0).cast("long")))


def _borrowed(held: DataFrame) -> DataFrame:
    """Turns, and those that the next block reads as its history: the last ``HISTORY`` turn numbers of each block."""
    late = (F.pmod("turn", F.lit(BLOCK)) >= BLOCK - HISTORY) & F.col("conv_id").isNotNull()
    place = lambda step, own: F.struct((F.col("block") + step).alias("block"), F.lit(own).alias("own"))
    every = F.when(F.coalesce(late, F.lit(False)), F.array(place(0, True), place(1, False))).otherwise(F.array(place(0, True)))
    return held.withColumn("p", F.explode(every)).withColumn("block", F.col("p.block")).withColumn("own", F.col("p.own")).withColumn("opening", F.lit(False)).drop("p")


def _openings(held: DataFrame) -> DataFrame:
    """The first system turn of a conversation's first block, once for each later block."""
    later = held.filter((F.col("block") > 0) & F.col("conv_id").isNotNull()).select("conv_id", "block").distinct()
    first = held.filter((F.col("role") == "system") & (F.col("block") <= 0) & F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text", "cost")).alias("s"))
    rows = later.join(first, "conv_id").select("conv_id", "s.turn", "s.role", "s.text", "s.cost", "block")
    return rows.withColumn("tie", F.lit(0).cast("long")).withColumn("own", F.lit(False)).withColumn("opening", F.lit(True))


def windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, **columns: str) -> DataFrame:
    """conv_id, block, tie, window, formatted, loss (spans of code points), repeated (turns at its head that are not new), n_turns, cost."""
    if not 0 <= history <= HISTORY:
        raise ValueError(f"history is up to {HISTORY} turns")
    held = turns(rows, **columns)
    longest = rows.groupBy(F.col(columns.get("id_col", "conv_id"))).count().agg(F.max("count")).first()[0] or 0
    every = _borrowed(held).unionByName(_openings(held))
    every = every.repartition("conv_id") if longest <= LONG else every.repartition("conv_id", "block", "tie")
    home = ["conv_id", "block", "tie"]
    own, usual, stride = F.col("own"), ~F.col("opening"), max(1, budget // 2)
    order = Window.partitionBy(*home).orderBy(F.col("opening").desc(), "own", "turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the system turn in force before a row: the block's opening, or the first system turn in it
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    system = F.first(F.when((F.col("role") == "system") & (own | F.col("opening")), F.struct("text", "cost")), ignorenulls=True).over(before)
    x = every.withColumn("sum", F.sum(F.when(own, F.col("cost")).otherwise(0)).over(upto)).withColumn("all", F.sum(F.when(usual, F.col("cost")).otherwise(0)).over(upto))
    x = x.withColumn("window", F.when(own, F.floor((F.col("sum") - 1) / stride))).withColumn("system", system).withColumn("place", F.row_number().over(order))
    fill = Window.partitionBy(*home, "window")
    x = x.withColumn("new", F.when(own, F.sum("cost").over(fill))).withColumn("begins", own & (F.col("place") == F.min("place").over(fill)))
    # a turn is history of a window that begins within the next few turns, if the turns from it on fit before it
    ahead = F.array(*(F.lead(F.when(F.col("begins"), F.struct("window", (F.lit(budget) - F.col("new") - F.coalesce("system.cost", F.lit(0)) - (F.col("all") - F.col("cost"))).alias("room"))), h).over(order) for h in range(1, history + 1))) if history else F.array().cast("array<struct<window:long,room:long>>")
    reach = F.transform(F.filter(ahead, lambda a: a.isNotNull() & (a["room"] + F.col("all") - F.col("cost") >= 0)), lambda a: a["window"])
    x = x.withColumn("reach", F.when(usual, reach).otherwise(F.array().cast("array<long>")))
    goes = F.concat(F.when(own, F.array(F.struct("window", F.lit(True).alias("fresh")))).otherwise(F.array().cast("array<struct<window:bigint,fresh:boolean>>")), F.transform("reach", lambda w: F.struct(w.alias("window"), F.lit(False).alias("fresh"))))
    x = x.select(*home, "place", "role", "text", "cost", F.when(F.col("begins"), F.col("system")).alias("system"), F.explode(goes).alias("g"))
    turn = F.struct("place", F.col("g.fresh").alias("fresh"), "role", "text")
    made = x.groupBy(*home, F.col("g.window").alias("window")).agg(F.array_sort(F.collect_list(turn)).alias("t"), F.max("system").alias("system"), F.sum("cost").alias("cost"))
    # the system turn is put in front unless it is among the window's turns already
    has = F.exists("t", lambda t: (t["role"] == "system") & (t["text"] == F.col("system.text")))
    put = F.array(F.struct(F.lit(0).alias("place"), F.lit(False).alias("fresh"), F.lit("system").alias("role"), F.col("system.text").alias("text")))
    made = made.withColumn("led", F.coalesce(F.col("system").isNotNull() & ~has, F.lit(False))).withColumn("t", F.when(F.col("led"), F.concat(put, F.col("t"))).otherwise(F.col("t")))
    heads, bodies = F.transform("t", lambda t: _head(t["role"])), F.transform("t", lambda t: escape(t["text"]))
    made = made.withColumn("heads", heads).withColumn("bodies", bodies)
    tail = F.lit(f"{END}\n")
    written = F.array_join(F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, tail)), "")
    # where each text begins: a fold over lengths
    step = F.zip_with(F.zip_with("heads", "bodies", lambda h, b: F.struct(F.length(h).cast("long").alias("h"), F.length(b).cast("long").alias("b"))), "t", lambda s, t: F.struct(s["h"].alias("h"), s["b"].alias("b"), (t["fresh"] & (t["role"] == "assistant")).alias("learn")))
    spans = F.aggregate(
        step, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda s, t: F.struct((s["at"] + t["h"] + t["b"] + len(END) + 1).alias("at"), F.when(t["learn"], F.concat(s["spans"], F.array(F.struct((s["at"] + t["h"]).alias("start"), t["b"].alias("length"))))).otherwise(s["spans"]).alias("spans")), lambda s: s["spans"],
    )
    stale = F.size(F.filter("t", lambda t: ~t["fresh"]))
    return made.select(*home, "window", written.alias("formatted"), spans.alias("loss"), stale.alias("repeated"), F.size("t").alias("n_turns"), (F.col("cost") + F.when(F.col("led"), F.col("system.cost")).otherwise(0)).alias("cost"))


def read(made: DataFrame) -> DataFrame:
    """conv_id, block, tie, window, turns (role, text; those that are new), learned (texts under the mask), length, from the formatted text and its spans alone."""
    marked = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda t: t != "")
    parsed = F.transform(marked, lambda t: F.struct(
        unescape(F.replace(F.substring_index(F.substring(t, len(START) + 1, 1 << 30), "\n", 1), F.lit(BREAK), F.lit("\n"))).alias("role"),
        unescape(F.substring(t, F.locate("\n", t) + 1, F.lit(1 << 30))).alias("text"),
    ))
    learned = F.transform("loss", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return made.select("conv_id", "block", "tie", "window", F.slice(parsed, F.col("repeated") + 1, F.greatest(F.size(parsed), F.lit(1))).alias("turns"), learned.alias("learned"), F.length("formatted").cast("long").alias("length"))


def digests(parsed: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows of each conversation that was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    part = parsed.select("conv_id", F.struct("block", "tie", "window", said.alias("said"), F.array_join("learned", "").alias("learned")).alias("w"), F.size("turns").alias("n"), "length")
    whole = part.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("n").cast("long").alias("n_turns"), F.sum("length").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"))
    joined = lambda field: F.array_join(F.transform("w", lambda x: x[field]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"), F.length(joined("learned")).cast("long").alias("loss_chars"), F.sha2(joined("learned"), 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )


def with_trial(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The conversations and one of id -1 whose texts look like the template."""
    odd = f"{END}{START}assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
