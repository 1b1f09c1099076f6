"""Conversations checked turn by turn and repaired at the least cost, by one fold over each conversation.

Windows over a conversation's rows give each row its first fault and its role's initial; the rows' small structs are
collected in order, and `aggregate()` folds over them. The fold carries four (cost, audit) structs: the cheapest edits
so far by what the repaired conversation ends with: nothing yet, a system turn, a user turn, an assistant turn. `least`
on these structs takes the smaller cost and, where costs tie, the audit first in ASCII. Edits of the same rows at the
same cost are never a prefix of each other, since only inserts add letters and each costs 2. So the smaller of two
beginnings stays the smaller one whatever follows, and one struct by ending is enough.

Edits: K keeps a row, R gives it the role user or assistant (2), D deletes it (3), I inserts a turn without text (2);
a truncated row that stays adds 1. Blank and duplicate rows must be deleted. What is left has the role initials
`(s?(ua)+)?`. A second fold reads the audit along the rows and writes the repaired turns.

Rows are one shuffle away, by conversation; windows, folds and hashes are built-in functions. A conversation's rows
meet in one row, as its hash is of its whole repaired text.

Odd rows: a null id, turn, role or text counts as one space where text is asked for; rows whose conversation id
is null are one conversation. Rows of one turn stand by role, then text, so that repeated rows stand together. Roles
whose first letter is none of s, u, a can't be kept. Conversations without rows give zeros, an empty audit and the
hash of an empty text. Extra columns are left out whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WHITE

#: What a deletion, a new role, an insert and a truncated row that stays add to the cost.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
ENDS = ".!?"
STATE = "struct<cost: bigint, audit: string>"
BLANK = WHITE.decode()


def rows_of(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, live) with nulls of role and text as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return df.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.lit(True).alias("live"))


def damage(df: DataFrame) -> DataFrame:
    """rows_of df after planned faults: by crc32 of `conv_id:turn` modulo 20, 0 drops a row (live is false), 1 empties
    its text, 2 takes its sentence ends away, 3 repeats it, 4 makes it the user's."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    rows = rows_of(df).withColumn("kind", kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("time")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("live"), times).drop("time")


def flagged(rows: DataFrame) -> DataFrame:
    """rows with their place n, initial, first fault, whether initial and the one before are an illegal pair, and whether the
    turn differs from the one before."""
    rows = rows.repartition("conv_id").withColumn("initial", F.substring("role", 1, 1)).withColumn("bare", F.rtrim("text", F.lit(BLANK)))
    order = [F.asc_nulls_first("turn"), "role", "text"]
    by = Window.partitionBy("conv_id", "live").orderBy(*order)
    same = Window.partitionBy("conv_id", "live", "role", "text").orderBy("n")  # n tells equal rows apart
    pair = F.concat(F.lag("initial").over(by), F.col("initial"))
    first = ~F.col("turn").eqNullSafe(F.lag("turn").over(by))
    rows = rows.select("*", F.row_number().over(by).alias("n"), F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"), first.alias("first"))
    fault = (
        F.when(F.col("bare") == "", "blank")
        .when(F.row_number().over(same) > 1, "duplicate")
        .when(~F.substring("bare", -1, 1).isin(*ENDS), "truncated")
    )
    return rows.select("conv_id", "turn", "role", "text", "live", "initial", "n", "illegal", "first", fault.alias("fault"))


def _after(state: Column, cost, letters: str | Column) -> Column:
    """The state after more edits; null where the state can't be reached."""
    letters = F.lit(letters) if isinstance(letters, str) else letters
    return F.when(state.isNotNull(), F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], letters).alias("audit")))


def _with_inserts(empty: Column, system: Column, user: Column, assistant: Column) -> Column:
    """The four states, when turns may be inserted behind them."""
    to_user = F.least(user, _after(empty, INSERT, "I"), _after(system, INSERT, "I"), _after(assistant, INSERT, "I"))
    to_assistant = F.least(assistant, _after(user, INSERT, "I"), _after(empty, 2 * INSERT, "II"), _after(system, 2 * INSERT, "II"))
    return F.struct(empty.alias("empty"), system.alias("system"), to_user.alias("user"), to_assistant.alias("assistant"))


def _step(acc: Column, turn: Column) -> Column:
    """The four states after one more row."""
    initial, stays = turn["initial"], ~turn["gone"]
    late = F.when(turn["late"], F.lit(TRUNCATED)).otherwise(F.lit(0))

    def placed(state: Column, letter: str) -> Column:
        kept = initial == letter
        return F.when(stays, _after(state, late + F.when(kept, 0).otherwise(REROLE), F.when(kept, "K").otherwise("R")))

    deleted = {k: _after(acc[k], DELETE, "D") for k in ("empty", "system", "user", "assistant")}
    return _with_inserts(
        deleted["empty"],
        F.least(deleted["system"], F.when(stays & (initial == "s"), _after(acc["empty"], late, "K"))),
        F.least(deleted["user"], placed(F.least(acc["empty"], acc["system"], acc["assistant"]), "u")),
        F.least(deleted["assistant"], placed(acc["user"], "a")),
    )


def _written(acc: Column, letter: Column, turns: Column) -> Column:
    """The repaired turns after one more letter of the audit: acc is (at, last, parts)."""
    takes = letter != "I"
    turn = F.get(turns, acc["at"])
    role = F.when(letter == "K", turn["role"]).when(acc["last"] == "u", "assistant").otherwise("user")
    adds = letter != "D"
    return F.struct(
        (acc["at"] + F.when(takes, 1).otherwise(0)).alias("at"),
        F.when(adds, F.substring(role, 1, 1)).otherwise(acc["last"]).alias("last"),
        F.when(adds, F.concat(acc["parts"], F.array(F.concat(role, F.lit(":"), F.when(takes, turn["text"]).otherwise("")))))
        .otherwise(acc["parts"])
        .alias("parts"),
    )


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conv_id of rows (conv_id, turn, role, text, live): counts, cost, audit and repaired, the turns left
    as `role:text`. Rows that are not live keep their conversation in the result and count for nothing else."""
    live = F.col("live")

    def count(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(live & condition, 1).otherwise(0)), F.lit(0)).cast("long").alias(name)

    turn = F.when(live, F.col("turn"))
    new_turn = live & F.col("turn").isNotNull() & F.col("first")
    fields = F.struct("n", "initial", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("gone"), F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("late"), "role", "text")
    found = flagged(rows).groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.sum(F.when(new_turn, 1).otherwise(0)), F.lit(0)).cast("long").alias("gaps"),
        *(count(F.coalesce(F.col("fault") == k, F.lit(False)), k) for k in ("blank", "duplicate", "truncated")),
        count(F.col("illegal"), "illegal"),
        F.sort_array(F.collect_list(F.when(live, fields))).alias("turns"),
    )
    start = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    none = F.lit(None).cast(STATE)
    ends = F.aggregate("turns", _with_inserts(start, none, none, none), _step, lambda acc: F.least(acc["empty"], acc["assistant"]))
    found = found.withColumn("best", ends)
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("last"), F.array().cast("array<string>").alias("parts"))
    letters = F.filter(F.split("best.audit", ""), lambda x: x != "")
    parts = F.aggregate(letters, begin, lambda acc, x: _written(acc, x, F.col("turns")), lambda acc: acc["parts"])
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", parts.alias("repaired"))
