"""Conversation structure repair by a fold over turns in Spark SQL's higher-order functions.

Turns get a total order by one range sort, so a conversation of any length lies in as many partitions as it needs. Fault
flags come with it: blank and truncated from the text, duplicate from the first place of each (role, text) of a
conversation, which is aggregated before it is shuffled. Blocks of at most BLOCK turns are collected as sorted structs and
folded by aggregate(), which carries four (cost, audit) structs, one for each state of the pattern `(s?(ua)+)?`:

    0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn (0 and 3 may end)

through least(): the structs compare by cost, then by audit. Choosing the least audit at each step is safe: audits of the same
turns and equal cost are never beginnings of one another (what an audit has more would cost more), so what follows both
can't turn their order. A conversation's first block is folded from state 0, others from each of the four; blocks then
compose, state by state, in the same way. No text is collected: the edits are replayed along the turns in
order, in a running hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrove.plans.session import written

SPACE = " \t\n\x0b\x0c\r"
#: Turns in a block: 2**6. Blocks of a conversation that are composed at once; beyond it, 2**6 at a time first.
BLOCK_BITS, MOST_BLOCKS = 6, 256
KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 2), ("D", 3), ("I", 2)
TRUNCATED = 1
#: The cost of a state that can't be reached.
NEVER = 1 << 40
_FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties the text, 2 takes
    .!? out, 3 repeats the row, 4 makes its role user. Nulls are one space there and in role and text."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    d = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    again = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return d.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), again.alias("copy")).drop("copy")


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, initial, digest, fault (b blank, d duplicate, t truncated, else empty) and `at`, which ascends by conversation and
    turn (nulls first; ties by role and text), without the texts."""
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(body == "", "b").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    thin = turns.select("conv_id", "turn", "role", F.left("role", F.lit(1)).alias("initial"), _digest(), fault.alias("fault"))
    sort = ["conv_id", "turn", "role", "digest"]
    placed = written(thin.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("at", F.monotonically_increasing_id()), "turns")
    same = ["conv_id", "role", "digest"]
    first = placed.groupBy(*same).agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select(*(F.col(c).alias(f"_{c}") for c in same), "first")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]
    again = (F.col("fault") != "b") & F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    return placed.join(first, on, "left").select("conv_id", "turn", "initial", "at", F.when(again, "d").otherwise(F.col("fault")).alias("fault"))


def _state(cost, audit) -> Column:
    return F.struct(cost.alias("cost"), audit.alias("audit"))


def _edit(s: Column, edit: tuple[str, int], more: Column | None = None) -> Column:
    cost = s["cost"] + F.lit(edit[1]).cast("long")
    return _state(cost if more is None else cost + more, F.concat(s["audit"], F.lit(edit[0])))


def _inserted(s: list[Column]) -> list[Column]:
    """The states where turns may be inserted first: at most a user's and an assistant's."""
    two = F.least(s[2], _edit(s[0], INSERT), _edit(s[1], INSERT), _edit(s[3], INSERT))
    return [s[0], s[1], two, F.least(s[3], _edit(two, INSERT))]


def _four(states: list[Column]) -> Column:
    return F.struct(*(x.alias(f"s{k}") for k, x in enumerate(states)))


def _step(acc: Column, turn: Column) -> Column:
    """The four states after a turn, which is kept, given another role, or deleted."""
    s = _inserted([acc[f"s{k}"] for k in range(4)])
    # deletion is the only way out of blank and duplicate turns
    more = F.when(turn["fault"].isin("b", "d"), F.lit(NEVER)).when(turn["fault"] == "t", F.lit(TRUNCATED)).otherwise(F.lit(0)).cast("long")

    def taken(before: Column, role: str) -> Column:
        own = turn["initial"] == role
        return _state(
            before["cost"] + more + F.when(own, F.lit(KEEP[1])).otherwise(F.lit(REROLE[1])).cast("long"),
            F.concat(before["audit"], F.when(own, F.lit(KEEP[0])).otherwise(F.lit(REROLE[0]))),
        )

    kept_system = F.when(turn["initial"] == "s", _edit(s[0], KEEP, more)).otherwise(_state(F.lit(NEVER).cast("long"), F.lit("")))
    return _four([
        _edit(s[0], DELETE),
        F.least(_edit(s[1], DELETE), kept_system),
        F.least(_edit(s[2], DELETE), taken(s[0], "u"), taken(s[1], "u"), taken(s[3], "u")),
        F.least(_edit(s[3], DELETE), taken(s[2], "a")),
    ])


def _fold(turns: str, entry: int) -> Column:
    never, start = _state(F.lit(NEVER).cast("long"), F.lit("")), _state(F.lit(0).cast("long"), F.lit(""))
    done = F.aggregate(F.col(turns), _four([start if k == entry else never for k in range(4)]), _step)
    return F.array(*(done[f"s{k}"] for k in range(4)))


def _illegal(a: Column, b: Column) -> Column:
    return ~F.concat(a, b).isin("su", "ua", "au")


def _n(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("long")


def folded_blocks(turns: DataFrame) -> DataFrame:
    """conv_id, block and `b`: counts, both ends and the map from states before to states after of each block of turns."""
    block = F.shiftright("at", BLOCK_BITS).alias("block")
    d = turns.groupBy("conv_id", block).agg(F.array_sort(F.collect_list(F.struct("at", "turn", "initial", "fault"))).alias("turns"))
    first = d.groupBy("conv_id").agg(F.min("block").alias("first")).withColumnRenamed("conv_id", "_conv_id")
    d = d.join(first, F.col("conv_id").eqNullSafe(F.col("_conv_id")))
    sized = lambda c: F.size(c).cast("long")
    before = lambda i: F.get("turns", i - 1)
    # initial and turn of the turn before, seen from each turn of the block
    illegal = F.filter("turns", lambda x, i: (i > 0) & _illegal(before(i)["initial"], x["initial"]))
    kinds = F.filter("turns", lambda x, i: x["turn"].isNotNull() & ((i == 0) | ~x["turn"].eqNullSafe(before(i)["turn"])))
    of = lambda f: sized(F.filter("turns", lambda x: x["fault"] == f))
    numbers = F.transform("turns", lambda x: x["turn"])
    last = F.element_at("turns", -1)
    one = F.array(_fold("turns", 0))
    maps = F.when(F.col("block") == F.col("first"), one).otherwise(F.concat(one, *(F.array(_fold("turns", k)) for k in (1, 2, 3))))
    return d.select("conv_id", "block", F.struct(
        F.array_min(numbers).alias("lo"), F.array_max(numbers).alias("hi"), sized(kinds).alias("kinds"), of("b").alias("blank"), of("d").alias("duplicate"), of("t").alias("truncated"),
        sized(illegal).alias("illegal"), F.col("turns")[0]["turn"].alias("first_turn"), F.col("turns")[0]["initial"].alias("first_initial"),
        last["turn"].alias("last_turn"), last["initial"].alias("last_initial"), maps.alias("map"),
    ).alias("b"))


def _composed(a: Column, b: Column) -> Column:
    """Two neighbouring blocks as one."""
    through = lambda row: F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda to: F.array_min(F.transform(row, lambda x, k: _state(x["cost"] + b["map"][k][to]["cost"], F.concat(x["audit"], b["map"][k][to]["audit"])))),
    )
    return F.struct(
        F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi"),
        (a["kinds"] + b["kinds"] - _n(a["last_turn"] == b["first_turn"])).alias("kinds"),
        *((a[c] + b[c]).alias(c) for c in ("blank", "duplicate", "truncated")),
        (a["illegal"] + b["illegal"] + _n(_illegal(a["last_initial"], b["first_initial"]))).alias("illegal"),
        a["first_turn"].alias("first_turn"), a["first_initial"].alias("first_initial"), b["last_turn"].alias("last_turn"), b["last_initial"].alias("last_initial"),
        F.transform(a["map"], through).alias("map"),
    )


def _together(blocks: DataFrame, *keys) -> DataFrame:
    """The blocks of each key composed in order."""
    d = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", "b"))).alias("_blocks"))
    rest = F.slice("_blocks", F.lit(2), F.size("_blocks"))
    return d.withColumn("b", F.aggregate(rest, F.col("_blocks")[0]["b"], lambda acc, x: _composed(acc, x["b"])))


def repairs(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each damaged conversation that has turns left."""
    blocks = written(folded_blocks(ordered_turns(damaged(conversations))), "blocks")
    while (blocks.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0) > MOST_BLOCKS:
        up = _together(blocks.withColumn("up", F.shiftright("block", BLOCK_BITS)), "conv_id", "up")
        blocks = written(up.select("conv_id", F.col("up").alias("block"), "b"), "blocks")
    d = _together(blocks, "conv_id")
    end = F.col("b.map")[0]
    best = F.least(end[0], _inserted([end[k] for k in range(4)])[3])
    gaps = F.coalesce(F.col("b.hi") - F.col("b.lo") + 1 - F.col("b.kinds"), F.lit(0).cast("long"))
    return d.withColumn("best", best).select("conv_id", gaps.alias("gaps"), "b.blank", "b.duplicate", "b.truncated", "b.illegal", "best.cost", "best.audit")


#: The state after a user's, an assistant's and a kept system turn.
_AFTER = {"s": 1, "u": 2, "a": 3}


class Replay:
    """Follows a conversation's audit along its turns: the repaired turns one by one."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _next(self) -> tuple[str, int]:
        return ("assistant", 3) if self.state == 2 else ("user", 2)

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == INSERT[0]:
            self.at += 1
            role, self.state = self._next()
            yield role, ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP[0]:
            self.state = _AFTER[role[0]]
            yield role, text
        elif edit == REROLE[0]:
            role, self.state = self._next()
            yield role, text


class _Hash:
    """SHA-256 of `role:text` lines, without the whole text in memory."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, turns: Iterator[tuple[str, str]]) -> None:
        for role, text in turns:
            self.sha.update((b"\n" if self.any else b"") + role.encode() + b":" + text.encode())
            self.any = True


def _along(repaired: DataFrame, conversations: DataFrame) -> DataFrame:
    """Rows of repaired as they are, each before the damaged turns of its conversation in order."""
    turns = damaged(conversations).select("conv_id", F.lit(1).alias("kind"), "turn", "role", _digest(), "text", *(F.lit(None).cast("long").alias(c) for c in _FIELDS[:-1]))
    heads = repaired.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"), *_FIELDS[:-1])
    return heads.union(turns).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").drop("digest", "turn")


def _with_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    head, replay, sha, out = None, None, None, []

    def ended() -> None:
        if head is not None:
            sha.add(replay.inserted())
            out.append((*head, sha.sha.hexdigest()))

    def batch() -> pa.RecordBatch:
        names = SCHEMA.split(", ")
        columns = [pa.array(list(c), pa.string() if n.endswith("string") else pa.int64()) for n, c in zip(names, zip(*out))]
        return pa.RecordBatch.from_arrays(columns, names=[n.split()[0] for n in names])

    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("kind", "role", "text", "conv_id", *_FIELDS[:-1])]
        for kind, role, text, *rest in zip(*columns):
            if kind == 0:
                ended()
                head, replay, sha = (*rest, text), Replay(text), _Hash()
            else:
                sha.add(replay.turn(role, text))
        if out:
            yield batch()
            out.clear()
    ended()
    if out:
        yield batch()


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    conversations has conv_id, turn, role, text. Rows are damaged (`damaged`), taken by turn (null first; rows of one turn by
    role and text, so repeated rows stay together) and repaired at least cost: keep 0, another role 2, delete 3, insert an
    empty user's or assistant's turn 2, and 1 for each truncated turn that stays; blank and duplicate turns must go. Of equal
    cost the least audit in ASCII counts. Null roles and texts are one space, a null turn lies in no gap, a null conv_id is a conversation
    too; empty and very long texts are treated alike. A conversation without rows after damage has zeros, an empty
    audit and the hash of nothing. Extra columns are ignored; an empty table gives an empty result."""
    everyone = conversations.select(F.col("conv_id").cast("long").alias("_conv_id")).distinct()
    found = everyone.join(repairs(conversations), F.col("_conv_id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _FIELDS[:-1]]
    whole = written(found.select(F.col("_conv_id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit")), "repairs")
    return _along(whole, conversations).mapInArrow(_with_hashes, SCHEMA)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (long, from 0), role, text: the turns of the repaired conversations, in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, replay, place = None, Replay(""), 0
        for b in batches:
            rows = []
            for kind, role, text, now in zip(*(b.column(c).to_pylist() for c in ("kind", "role", "text", "conv_id"))):
                done = [*replay.inserted()] if kind == 0 else [*replay.turn(role, text)]
                rows += [(conv, place + k, *x) for k, x in enumerate(done)]
                place += len(done)
                if kind == 0:
                    conv, replay, place = now, Replay(text), 0
            yield _turn_rows(rows)
        yield _turn_rows([(conv, place + k, *x) for k, x in enumerate(replay.inserted())])

    return _along(repairs(conversations), conversations).mapInArrow(run, "conv_id long, place long, role string, text string")


def _turn_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["conv_id", "place", "role", "text"])
