"""Chat formatting with budgeted windows, in DataFrame functions alone.

Turn template: ``[TURN role]text</s>`` for a turn that is new in its window, ``[HIST role]text</s>`` for a repeated one.
``&``, ``<``, ``[`` and ``]`` inside roles and texts are written as character references, so that no text can hold a
marker of this or another template, and reading back restores it exactly.

Windows: a window has the system turn, repeated history and new turns, all within ``budget`` tokens. What the system turn
and ``history`` leave is the room for new turns. Prefix sums of turn tokens place every turn on a line that is cut into cells
of half that room: turns of at most half the room that begin in one cell share a window, and a longer turn is a window of
its own. So new turns never pass the room, no two windows in a row are needlessly small, and no window depends on how the
ones before it were filled. A window repeats the last turns of the window before, as far as ``history`` tokens,
``history_turns`` turns and its own budget allow; repeated turns are out of the loss, and each assistant turn is in the loss
once. The one exception to the budget: a turn that passes it alone, or with the system turn, has a window with the system turn
and nothing else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import written

# The template's escapes; & comes first when writing and last when reading.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))
TURN = r"\[TURN ([^\]]*)\]([^<]*)</s>"
#: A token estimate that needs no vocabulary: runs of letters and digits, and each other visible character.
TOKENS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
BLOCK = 1024


def escaped(x: Column) -> Column:
    return reduce(lambda s, p: F.replace(s, F.lit(p[0]), F.lit(p[1])), ESCAPES, x)


def unescaped(x: Column) -> Column:
    return reduce(lambda s, p: F.replace(s, F.lit(p[1]), F.lit(p[0])), reversed(ESCAPES), x)


def windows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = 512, history: int = 128, history_turns: int = 2, tokens: Column | None = None) -> DataFrame:
    """``<conv>, window, formatted, losses``: the windows of each conversation, and the spans (``start, length`` in
    characters of ``formatted``) that are in the loss.

    ``window`` is the number, from 0, of the window's first new turn. Rows of a conversation are ordered by turn, then role
    and text; the first is the system turn if its role says so. A null role or text is empty, a null conversation id is an id
    of its own, null turns come first. Repeated rows are repeated turns, and texts of any length stay whole. Without rows there
    are no windows. Other columns are not read. A conversation of any length is cut in blocks of turns, so that prefix sums need
    no whole conversation at once.
    """
    base = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        (F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(TOKENS)) if tokens is None else tokens).cast("long").alias("t"),
    ).withColumn("t", F.col("t") + 4).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 40))))
    order = ["turn", "role", "text"]
    every = Window.partitionBy("conv").orderBy("block")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    blocks = base.groupBy("conv", "block").agg(F.sum("t").alias("bt"), F.count("*").alias("bn"), F.min(F.struct(*order, "t")).alias("first"))
    system = F.when(F.col("first.role") == "system", F.col("first.t")).otherwise(0)
    blocks = blocks.select("conv", "block", F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n0"), F.first(system).over(every).alias("sys"))
    blocks = blocks.withColumn("half", F.greatest(F.lit(1), F.floor((budget - F.col("sys") - history) / 2)))
    inner = Window.partitionBy("conv", "block").orderBy(*order)
    running = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = base.alias("b").join(blocks.alias("k"), F.col("b.conv").eqNullSafe(F.col("k.conv")) & (F.col("b.block") == F.col("k.block"))).select("b.*", "t0", "n0", "sys", "half")
    placed = b.withColumns({"seq": F.count("*").over(running) + F.col("n0") - 1, "stop": F.sum("t").over(running) + F.col("t0"), "next": F.lead("t").over(inner)})
    first = (F.col("seq") == 0) & (F.col("sys") > 0)
    # The system turn goes with the turn after it.
    placed = placed.withColumns({"first": first, "cell": F.floor(F.when(first, F.col("stop")).otherwise(F.col("stop") - F.col("t")) / F.col("half")), "long": F.coalesce(F.when(first, F.col("next")).otherwise(F.col("t")) > F.col("half"), F.lit(False))})
    keys = ["cell", "long"]
    new = F.when(~F.col("first"), F.col("t")).otherwise(0)
    spans = placed.groupBy("conv", *keys).agg(F.min("seq").alias("window"), F.count("*").alias("n"), F.max("stop").alias("end"), (budget - F.max("sys") - F.sum(new)).alias("room"))
    spans = written(spans, "spans")
    after = spans.select(F.col("conv").alias("a_conv"), F.col("window").alias("after"), F.col("room").alias("after_room"))
    spans = spans.join(after, F.col("conv").eqNullSafe(F.col("a_conv")) & (F.col("window") + F.col("n") == F.col("after")), "left").drop("a_conv", "room")
    s = spans.alias("s")
    p = placed.alias("p").join(s, F.col("p.conv").eqNullSafe(F.col("s.conv")) & (F.col("p.cell") == F.col("s.cell")) & (F.col("p.long") == F.col("s.long")))
    p = p.select("p.conv", "p.seq", "p.role", "p.text", "p.first", (F.col("s.end") - F.col("p.stop") + F.col("p.t")).alias("tail"), "s.window", "s.n", "s.after", "s.after_room")
    repeat = F.col("after").isNotNull() & (F.col("window") + F.col("n") - F.col("seq") <= history_turns) & (F.col("tail") <= F.least(F.lit(history), F.col("after_room"))) & ~F.col("first")
    into = F.when(repeat, F.array(F.struct("window", F.lit(True).alias("new")), F.struct(F.col("after").alias("window"), F.lit(False).alias("new")))).otherwise(F.array(F.struct("window", F.lit(True).alias("new"))))
    rows = p.select("conv", "seq", "role", "text", F.explode(into).alias("w")).select("conv", "seq", "role", "text", "w.window", "w.new")
    kept = p.where("first").select(F.col("conv").alias("k_conv"), "seq", "role", "text", F.col("window").alias("own"))
    again = spans.select("conv", "window").join(kept, F.col("conv").eqNullSafe(F.col("k_conv")) & (F.col("window") != F.col("own")))
    rows = rows.unionByName(again.select("conv", "seq", "role", "text", "window", F.lit(False).alias("new")))
    head = F.concat(F.when(F.col("new"), F.lit("[TURN ")).otherwise(F.lit("[HIST ")), escaped(F.col("role")), F.lit("]"))
    parts = rows.select("conv", "window", F.struct("seq", head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("new") & (F.col("role") == "assistant")).alias("loss")).alias("x"))
    whole = parts.groupBy("conv", "window").agg(F.array_sort(F.collect_list("x")).alias("x"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        body = s.at + F.length(x.head)
        span = F.struct(body.cast("long").alias("start"), F.length(x.body).cast("long").alias("length"))
        return F.struct((body + F.length(x.body) + 4).cast("long").alias("at"), F.when(x.loss, F.array_append(s.out, span)).otherwise(s.out).alias("out"))

    formatted = F.array_join(F.transform("x", lambda x: F.concat(x.head, x.body, F.lit("</s>"))), "")
    return whole.select(F.col("conv").alias(conv_col), "window", formatted.alias("formatted"), F.aggregate("x", start, step).out.alias("losses"))


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``<conv>, turns, losses, formatted_chars`` from the windows alone: the turns (``role, text``) in order, each once,
    and the texts under the loss mask."""
    roles, texts = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(1)), F.regexp_extract_all("formatted", F.lit(TURN), F.lit(2))
    turns = F.transform(F.arrays_zip(roles.alias("role"), texts.alias("text")), lambda x: F.struct(unescaped(x.role).alias("role"), unescaped(x.text).alias("text")))
    losses = F.transform("losses", lambda x: unescaped(F.substring(F.col("formatted"), (x.start + 1).cast("int"), x.length.cast("int"))))
    parts = formatted.select(F.col(conv_col).alias("conv"), F.struct("window", turns.alias("turns"), losses.alias("losses")).alias("x"), F.length("formatted").cast("long").alias("n"))
    whole = parts.groupBy("conv").agg(F.array_sort(F.collect_list("x")).alias("x"), F.sum("n").alias("formatted_chars"))
    return whole.select(F.col("conv").alias(conv_col), F.flatten(F.col("x.turns")).alias("turns"), F.flatten(F.col("x.losses")).alias("losses"), "formatted_chars")
