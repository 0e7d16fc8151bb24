"""Chat formatting: roles of raw transcripts by a hidden Markov model.

A transcript is a table of lines (conv_id, line_no, text) in order of line_no.
A state is a role with whether the line begins a turn. Each line shows a
speaker marker, if any, and features (question, length, blank); start,
transition and emission probabilities are counted from labelled lines. Viterbi
runs in blocks: each block of lines gives a (max, +) matrix between the states
at its borders, the matrices of a conversation are chained, and each block is
then traced back between its known borders. So a conversation of any length
is split over tasks and the result is that of one long pass.

Recovered turns are rendered with their markers taken away.

Defined results: null texts are blank lines; a null conv_id is a conversation
of its own; lines with the same number are taken in order of their text; a null
number is the largest one, and a null turn comes after all others;
without labelled lines all states are alike and the first role wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

ROLES = ("user", "assistant", "system", "tool")
STATES = [(r, first) for r in ROLES for first in (True, False)]
#: Speaker markers by role; a marker ends with a colon or stands in ### or <| |>.
MARKERS = {"user": ("user", "human", "q", "customer"), "assistant": ("assistant", "ai", "a", "bot"), "system": ("system", "instructions"), "tool": ("tool", "function", "observation")}
_ANY = "|".join(n for names in MARKERS.values() for n in names)
MARKER = rf"(?i)^\s*(?:###\s*({_ANY})\s*:?|<\|({_ANY})\|>|\[({_ANY})\]|({_ANY})\s*[:>])[ \t]*"
BLOCK = 128
K = len(STATES)


def marker_class(text: Column) -> Column:
    """Place in ROLES plus one of the marker that begins the line, 0 if none does."""
    name = F.lower(F.concat(*[F.regexp_extract(text, MARKER, g) for g in (1, 2, 3, 4)]))
    out = F.lit(0)
    for k, r in enumerate(ROLES):
        out = F.when(name.isin(*MARKERS[r]), k + 1).otherwise(out)
    return out


def observe(lines: DataFrame) -> DataFrame:
    """lines with ``obs``, one symbol for the marker and the features of a line."""
    t = F.coalesce(F.col("text"), F.lit(""))
    size = F.length(t)
    bucket = F.when(size == 0, 0).when(size < 40, 1).when(size < 120, 2).when(size < 400, 3).otherwise(4)
    return lines.withColumn("obs", (marker_class(t) * 10 + bucket * 2 + t.rlike(r"\?\s*$").cast("int")).cast("int"))


SYMBOLS = 10 * (len(ROLES) + 1)


def learn(labelled: DataFrame, smooth: float = 0.1) -> dict[str, np.ndarray]:
    """Log probabilities from lines (conv_id, line_no, text, role, first). At most states * symbols and states squared counts reach the driver."""
    state = F.lit(None).cast("int")
    for k, (r, first) in enumerate(STATES):
        state = F.when((F.col("role") == r) & (F.col("first") == first), k).otherwise(state)
    seen = observe(labelled).withColumn("state", state).where("state IS NOT NULL")
    emit, move, start = np.full((K, SYMBOLS), smooth), np.full((K, K), smooth), np.full(K, smooth)
    for r in seen.groupBy("state", "obs").count().collect():
        emit[r["state"], r["obs"]] += r["count"]
    # a line's successor in its turn follows from the turn itself; the first line of the next turn from a join on the turn's number
    turn = seen.groupBy("conv_id", "turn").agg(F.min("state").alias("s"), F.count("*").alias("n"), F.min("role").alias("role"))
    inner = turn.groupBy("s").agg(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("go"), F.sum(F.when(F.col("n") > 1, F.col("n") - 2).otherwise(0)).alias("stay")).collect()
    for r in inner:
        move[r["s"], r["s"] | 1] += r["go"]
        move[r["s"] | 1, r["s"] | 1] += r["stay"]
    after = turn.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("s2"))
    for r in turn.join(after, ["conv_id", "turn"]).groupBy("s", (F.col("n") > 1).alias("more"), "s2").count().collect():
        move[r["s"] | int(r["more"]), r["s2"]] += r["count"]
    for r in turn.where("turn = 0").groupBy("s").count().collect():
        start[r["s"]] += r["count"]
    start[1::2] = 1e-12  # a transcript begins with a turn
    for k in range(0, K, 2):  # a turn goes on with its own role only
        for j in range(K):
            if j % 2 and j != (k | 1):
                move[k, j] = move[k | 1, j] = 1e-12
    log = lambda x: np.log(x / x.sum(-1, keepdims=True))
    return {"emit": log(emit), "move": log(move), "start": log(start)}


def block_matrix(obs: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """Best log probability from each state before the block to each state at its end."""
    best = model["move"] + model["emit"][:, obs[0]]
    for o in obs[1:]:
        best = (best[:, :, None] + model["move"][None]).max(1) + model["emit"][:, o]
    return best


def trace(obs: np.ndarray, model: dict[str, np.ndarray], before: int | None, end: int | None) -> list[int]:
    """The best states of a block between the state before it (None: the start) and that at its end (None: any)."""
    best = (model["start"] if before is None else model["move"][before]) + model["emit"][:, obs[0]]
    back = []
    for o in obs[1:]:
        ways = best[:, None] + model["move"]
        back.append(ways.argmax(0))
        best = ways.max(0) + model["emit"][:, o]
    s = int(best.argmax()) if end is None else end
    out = [s]
    for b in reversed(back):
        s = int(b[s])
        out.append(s)
    return out[::-1]


def chain(matrices: list[np.ndarray], first: np.ndarray) -> list[int]:
    """The states at the ends of blocks: the first block's best by end state, then the other blocks' matrices."""
    best, back = first, []
    for m in matrices:
        ways = best[:, None] + m
        back.append(ways.argmax(0))
        best = ways.max(0)
    s = int(best.argmax())
    out = [s]
    for b in reversed(back):
        s = int(b[s])
        out.append(s)
    return out[::-1]


def decode(lines: DataFrame, model: dict[str, np.ndarray], per: int = BLOCK) -> DataFrame:
    """conv_id, line_no, text, role, first for lines (conv_id, line_no, text); a block has the lines of ``per`` numbers."""
    spark = lines.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = observe(lines.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("line_no").cast("long"), F.lit((1 << 63) - 1)).alias("line_no"), F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.withColumn("block", F.expr(f"line_no div {per}"))

    def summarise(key, table):
        table = table.sort_by([("line_no", "ascending"), ("text", "ascending")])
        obs, m = table["obs"].to_numpy(), shared.value
        start = m["start"] + m["emit"][:, obs[0]]
        for o in obs[1:]:
            start = (start[:, None] + m["move"]).max(0) + m["emit"][:, o]
        return pa.table({"conv_id": [key[0].as_py()], "block": [key[1].as_py()], "m": [block_matrix(obs, m).ravel().tolist()], "start": [start.tolist()]}, schema=pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("m", pa.list_(pa.float64())), ("start", pa.list_(pa.float64()))]))

    sums = materialise(rows.select("conv_id", "block", "line_no", "text", "obs").groupBy("conv_id", "block").applyInArrow(summarise, "conv_id long, block long, m array<double>, start array<double>"), "chat-blocks")

    def borders(key, table):
        table = table.sort_by("block")
        ms = [np.array(x).reshape(K, K) for x in table["m"].to_pylist()[1:]]
        ends = chain(ms, np.array(table["start"][0].as_py()))
        return pa.table({"conv_id": table["conv_id"], "block": table["block"], "before": pa.array([None, *ends[:-1]], pa.int32()), "end": pa.array(ends, pa.int32())})

    # one row for each block, of a fixed size: all that a conversation gathers
    known = materialise(sums.groupBy("conv_id").applyInArrow(borders, "conv_id long, block long, before int, end int"), "chat-borders")
    both = rows.join(known.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "before", "end"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))

    def backtrace(key, table):
        table = table.sort_by([("line_no", "ascending"), ("text", "ascending")])
        states = trace(table["obs"].to_numpy(), shared.value, table["before"][0].as_py(), table["end"][0].as_py())
        return pa.table({"conv_id": table["conv_id"], "line_no": table["line_no"], "text": table["text"], "role": pa.array([STATES[s][0] for s in states]), "first": pa.array([STATES[s][1] for s in states])})

    return both.select("conv_id", "block", "line_no", "text", "obs", "before", "end").groupBy("conv_id", "block").applyInArrow(backtrace, "conv_id long, line_no long, text string, role string, first boolean")


def clean(text: Column) -> Column:
    return F.regexp_replace(text, MARKER, "")


def render(decoded: DataFrame, per: int = BLOCK) -> DataFrame:
    """One row for each recovered turn: conv_id, line_no (of its first line), role, n_lines, rendered.

    A line's turn is the last first line up to it: the last one in its block, else the one that was open before the block, which a scan of one row a block finds.
    """
    from pyspark.sql import Window as W

    rows = materialise(decoded.withColumn("block", F.expr(f"line_no div {per}")), "chat-lines")
    here = W.partitionBy("conv_id", "block").orderBy("line_no", "text").rowsBetween(W.unboundedPreceding, 0)
    opened = F.last(F.when(F.col("first"), F.col("line_no")), ignorenulls=True)
    ends = rows.groupBy("conv_id", "block").agg(F.max(F.when(F.col("first"), F.col("line_no"))).alias("o"))
    past = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.last("o", ignorenulls=True).over(past).alias("open"))
    lines = rows.withColumn("o", opened.over(here)).join(carried, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))).withColumn("turn_line", F.coalesce("o", "open", F.lit(0)))
    turns = lines.groupBy("conv_id", "turn_line").agg(F.array_sort(F.collect_list(F.struct("line_no", "text", "first", "role"))).alias("x"))
    body = F.array_join(F.transform("x", lambda y: F.when(y["first"], F.regexp_replace(y["text"], MARKER, "")).otherwise(y["text"])), "\n")
    role = F.col("x")[0]["role"]
    return turns.select("conv_id", F.col("turn_line").alias("line_no"), role.alias("role"), F.size("x").alias("n_lines"), F.concat(F.lit("<|"), role, F.lit("|>\n"), body, F.lit("\n<|end|>\n")).alias("rendered"))


def split_lines(texts: DataFrame) -> DataFrame:
    """Lines of raw transcripts (conv_id, text)."""
    return texts.select("conv_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "text"))


NO_TURN = (1 << 31) - 1


def line_number(turn: Column, k: Column) -> Column:
    """One number in the order of (turn, line of the turn); a turn has less than 2 ** 32 lines."""
    return F.shiftleft(F.coalesce(turn.cast("long"), F.lit(NO_TURN).cast("long")), 32) + k


def transcript_lines(turns: DataFrame, unmarked: int = 4) -> DataFrame:
    """A raw transcript of turns (conv_id, turn, role, text): each turn begins with one of several speaker markers, and one turn in ``unmarked`` has none. Carries role and first, for learning and for measuring."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    pick = F.pmod(F.xxhash64(conv, F.col("turn")), F.lit(unmarked * 4))
    name = F.lit(None).cast("string")
    for r in ROLES:
        own = MARKERS[r]
        name = F.when(F.col("role") == r, F.element_at(F.array(*[F.lit(n) for n in own]), (pick % len(own) + 1).cast("int"))).otherwise(name)
    style = (pick / 4).cast("int") % 3
    mark = F.when(F.pmod(F.xxhash64(F.col("turn"), conv), F.lit(unmarked)) == 0, "").when(style == 0, F.concat(F.initcap(name), F.lit(": "))).when(style == 1, F.concat(F.lit("### "), name, F.lit(": "))).otherwise(F.concat(F.lit("<|"), name, F.lit("|>")))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.posexplode(F.split(F.concat(F.coalesce(mark, F.lit("")), F.coalesce("text", F.lit(""))), "\n")).alias("k", "text"))
    return rows.select("conv_id", "turn", "k", "role", "text", (F.col("k") == 0).alias("first"))

