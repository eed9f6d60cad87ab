"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns are numbered through their conversation and gathered in stretches of ``BLOCK``. Greedy spans that end at turns are
chosen over token counts alone, one number for each turn; each span is a window, whichever stretches it touches, and only
these stretches' texts meet it. A window starts with the conversation's system turn, repeats earlier turns up to
``history`` tokens, then has its own turns. The loss mask covers the texts of its own assistant turns and nothing that is
repeated.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside texts a backslash is doubled, and a control
string gets one behind its first character; roles are percent-encoded. Both can be undone, see ``read_back``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common templates, without their first character.
RESTS = r"\|im_start\|>|\|im_end\|>|/?s>|<SYS>>|</SYS>>|/?INST\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"([<\[])(?=(?:{RESTS}))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, rf"([<\[])\\(?=(?:{RESTS}))", "$1"), F.lit("\\\\"), F.lit("\\"))


def default_tokens(text: Column) -> Column:
    """Runs of letters and digits, and single other signs."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"))


def _turns(df: DataFrame, conv_id: str, turn: str, role: str, text: str, tokens: Column | None) -> DataFrame:
    body = escape(F.coalesce(F.col(text), F.lit("")))
    name = F.url_encode(F.coalesce(F.col(role), F.lit("")))
    count = tokens if tokens is not None else default_tokens(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(
        F.col(conv_id).alias("conv_id"),
        F.floor(F.col(turn) / BLOCK).alias("near"),
        F.struct(
            F.col(turn).alias("turn"), name.alias("role"), F.concat(F.lit(OPEN), name, F.lit("\n"), body, F.lit(CLOSE)).alias("piece"),
            (F.char_length(name) + len(OPEN) + 1).alias("head"), F.char_length(body).alias("size"), F.coalesce(count, F.lit(0)).cast("long").alias("tok"),
        ).alias("t"),
    )
    # numbered among neighbouring turn numbers, behind all rows before these: texts are not sorted by whole conversations
    since = F.sum("n").over(Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy(F.col("conv_id").alias("c"), F.col("near").alias("r")).agg(F.count("*").alias("n")).select("c", "r", F.coalesce(since, F.lit(0)).alias("since"))
    rows = rows.join(sizes, rows.conv_id.eqNullSafe(sizes.c) & rows.near.eqNullSafe(sizes.r))
    rows = rows.select("conv_id", "t", (F.col("since") + F.row_number().over(Window.partitionBy("conv_id", "near").orderBy("t")) - 1).alias("i"))
    turns = F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))), lambda x: x["t"])
    return rows.groupBy("conv_id", F.floor(F.col("i") / BLOCK).alias("block")).agg(turns.alias("turns"))


def _spans(b: DataFrame, budget: int, history: int) -> DataFrame:
    """``(c, window, start, end, back, lead)``: the turns of each window, numbered through the conversation, the first that
    it repeats, and whether the system turn comes before that."""
    long = lambda x: F.lit(x).cast("long")
    none = F.expr("cast(array() as array<bigint>)")
    lead = F.when((F.col("block") == 0) & (F.col("turns")[0]["role"] == "system"), F.col("turns")[0]["tok"])
    toks = b.select("conv_id", "block", F.transform("turns", lambda x: x["tok"]).alias("toks"), lead.alias("lead"))
    talk = toks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "toks"))).alias("all"), F.max("lead").alias("lead"))
    room = long(budget - history) - F.coalesce("lead", long(0))

    def step(a: Column, tok: Column) -> Column:
        cut = (a["i"] > 0) & (a["open"] + tok > F.when(a["first"], long(budget)).otherwise(room))
        return F.struct(
            (a["i"] + 1).alias("i"), F.when(cut, tok).otherwise(a["open"] + tok).alias("open"), (a["first"] & ~cut).alias("first"),
            F.when(cut, F.concat(a["starts"], F.array(a["i"]))).otherwise(a["starts"]).alias("starts"),
        )

    def stretch(a: Column, x: Column) -> Column:
        got = F.aggregate(x["toks"], F.struct(a["i"].alias("i"), a["open"].alias("open"), a["first"].alias("first"), none.alias("starts")), step)
        return F.transform(F.array(got), lambda g: F.struct(g["i"].alias("i"), g["open"].alias("open"), g["first"].alias("first"), F.concat(a["starts"], F.array(g["starts"])).alias("starts")))[0]

    zero = F.struct(long(0).alias("i"), long(0).alias("open"), F.lit(True).alias("first"), F.expr("cast(array() as array<array<bigint>>)").alias("starts"))
    talk = talk.select("conv_id", "lead", F.aggregate("all", zero, stretch).alias("done"))
    talk = talk.select("conv_id", "lead", F.concat(F.array(long(0)), F.flatten("done.starts")).alias("start"), F.col("done.i").alias("n"))
    talk = talk.select("conv_id", "lead", F.posexplode(F.arrays_zip("start", F.concat(F.slice("start", 2, F.size("start")), F.array("n")).alias("end"))).alias("window", "span"))
    each = toks.select("conv_id", "block", F.posexplode("toks").alias("at", "tok")).select("conv_id", (F.col("block") * BLOCK + F.col("at")).alias("i"), "tok")
    each = each.withColumn("before", F.sum("tok").over(Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tok"))
    each = each.select(F.col("conv_id").alias("c"), "i", F.min("i").over(Window.partitionBy("conv_id").orderBy("before").rangeBetween(-history, 0)).alias("back"))
    talk = talk.join(each, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("span.start") == F.col("i")))
    return talk.select("c", "window", F.col("span.start").alias("start"), F.col("span.end").alias("end"), "back", (F.col("lead").isNotNull() & (F.col("back") > 0)).alias("lead"))


def windows(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = 1024, history: int = 256, tokens: Column | None = None) -> DataFrame:
    """``(conv_id, block, window, formatted, n_repeated, mask)``: windows of every conversation, in order of
    ``window``, and the stretch that each starts in; ``mask`` has start and length, in characters of ``formatted``, of the texts that are learnt from.

    Turns are ordered by number, then by role and text as the template writes them; repeated rows are turns of their own. Null text and null role are
    empty, a null number comes first, null ids are one conversation. A turn that is larger than the budget has a window
    of its own, whole. Only the named columns are read, so other columns cannot clash; no rows give no windows.
    """
    b = _turns(df, conv_id, turn, role, text, tokens)
    of = F.transform(F.sequence(F.floor(F.col("back") / BLOCK), F.floor((F.col("end") - 1) / BLOCK)), lambda k: F.struct(k.alias("no"), k.alias("in"), F.greatest("back", k * BLOCK).alias("lo"), F.least("end", (k + 1) * BLOCK).alias("hi")))
    first = F.expr("array(struct(-1L as no, 0L as `in`, 0L as lo, 1L as hi))")
    spans = _spans(b, budget, history).select("c", "window", "start", F.explode(F.when(F.col("lead"), F.concat(first, of)).otherwise(of)).alias("p"))
    b = b.join(spans, b.conv_id.eqNullSafe(spans.c) & (F.col("block") == F.col("p.in")))
    lo, hi, start, base = F.col("p.lo"), F.col("p.hi"), F.col("start"), F.col("block") * BLOCK - 1
    part = lambda x, y: F.slice("turns", (x - base).cast("int"), F.greatest(y - x, F.lit(0)).cast("int"))
    parts = F.struct(F.col("p.no").alias("no"), part(lo, F.least(hi, start)).alias("old"), part(F.greatest(lo, start), hi).alias("new"))
    b = b.groupBy("conv_id", F.floor(start / BLOCK).alias("block"), "window").agg(F.sort_array(F.collect_list(parts)).alias("parts"))
    b = b.select("conv_id", "block", "window", F.flatten("parts.old").alias("old"), F.flatten("parts.new").alias("new"))
    join = lambda c: F.array_join(F.transform(c, lambda x: x["piece"]), "")
    begin = F.struct(F.char_length(join("old")).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("mask"))

    def mark(a: Column, x: Column) -> Column:
        here = F.array(F.struct((a["at"] + x["head"]).alias("start"), x["size"].alias("length")))
        return F.struct((a["at"] + F.char_length(x["piece"])).alias("at"), F.when(x["role"] == "assistant", F.concat(a["mask"], here)).otherwise(a["mask"]).alias("mask"))

    return b.select(
        "conv_id", "block", "window", join(F.concat("old", "new")).alias("formatted"), F.size("old").alias("n_repeated"), F.aggregate("new", begin, mark)["mask"].alias("mask")
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Turns of each window that it does not repeat, read from its text: ``turns`` (role and text), and ``learnt``, the
    texts under its mask."""
    parts = F.split("formatted", r"<\|im_end\|>\n")
    parts = F.slice(parts, F.col("n_repeated") + 1, F.greatest(F.size(parts) - 1 - F.col("n_repeated"), F.lit(0)))
    inner = lambda p: F.substr(p, F.lit(len(OPEN) + 1))
    turns = F.transform(parts, lambda p: F.struct(F.url_decode(F.substring_index(inner(p), "\n", 1)).alias("role"), unescape(F.substr(inner(p), F.instr(inner(p), "\n") + 1)).alias("text")))
    learnt = F.transform("mask", lambda m: unescape(F.substr(F.col("formatted"), m["start"] + 1, m["length"])))
    return windows.select("conv_id", "block", "window", "formatted", turns.alias("turns"), learnt.alias("learnt"))
