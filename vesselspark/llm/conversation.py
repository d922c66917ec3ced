"""Conversation repair: turns aligned to the alternating grammar `(s?(ua)+)?` by Wagner-Fischer tables in Ukkonen bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import maybe_broadcast, written

#: Costs of edits; an undeleted truncated turn costs CUT more.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
FAR = 1 << 28
#: What of the grammar has been produced: nothing, the system turn, up to a user turn, up to an assistant turn.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: Characters that alone make no text.
SPACES = " \t\n\x0b\x0c\r"


def follows(state: int, code: str, edit: str) -> str:
    """The initial that the next turn of the result has."""
    return "a" if state == USER else "s" if state == NONE and edit == "K" and code in "sS" else "u"


class Table:
    """A code of a turn is its role's initial (x: no such role), in upper case where the turn is truncated; d must be deleted.

    Costs of aligning turns i.. of a block with the last r initials of a target that ends in state `end`.

    Targets of all lengths end alike, so one table holds them all: column r is the target of r initials. `whole` is the cost of the
    way along the diagonal, the first incumbent. An entry is needed only where the turns and initials left differ in number by what
    the incumbent pays for in edits, which bounds the columns of each row (low[i] is the first).
    """

    def __init__(self, code: str, end: int):
        self.code, self.end, n = code, end, len(code)
        last = "a" if end == ASSISTANT else "u"
        other = "u" if last == "a" else "a"
        self.chars = (other, last)  # the initial at r left is chars[r % 2]
        forced = code.count("d")
        live = [c for c in code if c != "d"]
        diagonal = sum(self.swap(c, self.chars[(len(live) - k) % 2]) for k, c in enumerate(live))
        room = diagonal + 2 * INSERT
        self.whole = room + DELETE * forced
        down, up = room // DELETE + 1, room // INSERT
        self.rows: list[np.ndarray] = [np.zeros(0, np.int64)] * (n + 1)
        self.low, self.after_s = [0] * (n + 1), [np.zeros(0, np.int64)] * (n + 1)
        left, self.rows[n] = 0, np.arange(up + 1, dtype=np.int64) * INSERT
        self.after_s[n] = np.full(up + 1, FAR, np.int64)
        for i in range(n - 1, -1, -1):
            c = code[i]
            left += c != "d"
            low, high = max(0, left - down), left + up
            r = np.arange(low, high + 1)
            below = self.cut(self.rows[i + 1], self.low[i + 1], low, high)
            row = below + DELETE
            if c != "d":
                swap = np.array([self.swap(c, x) for x in self.chars])[r % 2]
                before = self.cut(self.rows[i + 1], self.low[i + 1], low - 1, high - 1)
                row = np.minimum(row, before + swap)
            # a run of insertions ends the cheapest of the columns to the left
            row = np.minimum(np.minimum.accumulate(row - r * INSERT) + r * INSERT, FAR)
            self.low[i], self.rows[i] = low, row
            started = self.cut(self.after_s[i + 1], self.low[i + 1], low, high) + DELETE
            if c in "sS":
                started = np.minimum(started, below + (CUT if c == "S" else 0))
            self.after_s[i] = np.minimum(started, FAR)

    @staticmethod
    def swap(code: str, char: str) -> int:
        return (0 if code in (char, char.upper()) else REROLE) + (CUT if code.isupper() else 0)

    @staticmethod
    def cut(row: np.ndarray, begin: int, low: int, high: int) -> np.ndarray:
        """Columns low to high of a row that begins at begin; FAR outside the band."""
        out = np.full(high - low + 1, FAR, np.int64)
        first, last = max(low, begin), min(high, begin + len(row) - 1)
        if first <= last:
            out[first - low : last - low + 1] = row[first - begin : last - begin + 1]
        return out

    def at(self, rows: list[np.ndarray], i: int, r: int) -> int:
        k = r - self.low[i]
        return int(rows[i][k]) if 0 <= k < len(rows[i]) else FAR

    def trace(self, r: int, started: bool) -> str:
        """The ASCII-least cheapest audit for the target of r initials, after a system turn if started."""
        code, out, i = self.code, [], 0
        n, rows = len(code), self.after_s if started else self.rows
        while i < n or r:
            here = self.at(rows, i, r)
            if i < n and self.at(rows, i + 1, r) + DELETE == here:
                out.append("D")
                i += 1
            elif rows is self.rows and r and self.at(rows, i, r - 1) + INSERT == here:
                out.append("I")
                r -= 1
            elif rows is self.after_s:
                out.append("K")
                rows, i = self.rows, i + 1
            else:
                out.append("K" if code[i].lower() == self.chars[r % 2] else "R")
                r, i = r - 1, i + 1
        return "".join(out)

    def best(self, start: int) -> tuple[int, str] | None:
        """(cost, audit) of the cheapest target that leads from start to this table's end, of the ASCII-least audit."""
        same = start == self.end
        # an even number of initials leads from a state to itself, or from nothing or a system turn to an assistant turn
        parity = 0 if same or (self.end == ASSISTANT and start in (NONE, SYSTEM)) else 1
        low = self.low[0]
        r = np.arange(low, low + len(self.rows[0]))
        fits = (r % 2 == parity) & ((r > 0) | same)
        choices = [(np.where(fits, self.rows[0], FAR), False)]
        if start == NONE:
            choices.append((np.where(fits, self.after_s[0], FAR), True))
        cost = min(int(c.min()) for c, _ in choices)
        if cost >= FAR:
            return None
        return cost, min(self.trace(low + int(k), s) for c, s in choices for k in np.flatnonzero(c == cost))


def deleted(code: str) -> tuple[int, str]:
    return DELETE * len(code), "D" * len(code)


def only_system(code: str) -> tuple[int, str] | None:
    """All turns but one system turn deleted."""
    spots = [(CUT if c == "S" else 0, k) for k, c in enumerate(code) if c in "sS"]
    if not spots:
        return None
    # the latest of the cheapest makes the least audit, as D comes before K
    cut, k = min(spots, key=lambda x: (x[0], -x[1]))
    return cut + DELETE * (len(code) - 1), "D" * k + "K" + "D" * (len(code) - k - 1)


def align(code: str, starts: tuple[int, ...] = (NONE,), ends: tuple[int, ...] = (NONE, ASSISTANT)) -> dict[tuple[int, int], tuple[int, str]]:
    """For each state before and after a block of turns the least (cost, audit)."""
    out: dict[tuple[int, int], tuple[int, str]] = {}
    tables = {end: Table(code, end) for end in ends if end in (USER, ASSISTANT)}
    for start in starts:
        for end in ends:
            if end in tables:
                found = tables[end].best(start)
            elif end == start:
                found = deleted(code)
            else:
                found = only_system(code) if (start, end) == (NONE, SYSTEM) else None
            if found:
                out[start, end] = found
    return out


short = lru_cache(1 << 16)(align)


class Repair:
    """A conversation as it streams by: its turns come in blocks, and only the best way into each state is kept, with its hash so far.

    Of two ways into a state that cost the same neither audit begins the other (what is longer has more insertions, which cost), so the
    smaller one stays the smaller whatever follows, and blocks may be settled one by one.
    """

    def __init__(self, conv: object, block: int):
        self.conv, self.block = conv, block
        self.codes: list[str] = []
        self.rows: list[tuple[bytes, bytes]] = []
        self.ways = {NONE: (0, "", hashlib.sha256(), 0)}
        self.seen: tuple | None = None
        self.before = None
        self.faults = [0, 0, 0]
        self.illegal, self.low, self.high, self.turns = 0, None, None, 0

    def add(self, turn: int | None, role: bytes, text: bytes, initial: str, fault: int) -> None:
        """fault: 0 none, 1 blank, 2 seen at an earlier turn, 3 truncated. Turns come in order of turn, role, text."""
        if self.seen == (turn, role, text) and fault != 1:
            fault = 2
        if turn is not None:
            self.turns += self.seen is None or self.seen[0] != turn
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.seen = (turn, role, text)
        if fault:
            self.faults[fault - 1] += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        code = initial if initial in ("s", "u", "a") else "x"
        self.codes.append("d" if fault in (1, 2) else code.upper() if fault == 3 else code)
        self.rows.append((role, text))
        if len(self.codes) == self.block:
            self.settle((NONE, SYSTEM, USER, ASSISTANT))

    def settle(self, ends: tuple[int, ...]) -> None:
        code, best = "".join(self.codes), {}
        found = (short if len(code) <= 12 else align)(code, tuple(sorted(self.ways)), ends)
        for (start, end), (cost, audit) in found.items():
            way = (self.ways[start][0] + cost, self.ways[start][1] + audit, start, audit)
            if end not in best or way[:2] < best[end][:2]:
                best[end] = way
        self.ways = {end: (cost, audit, *self.write(start, part)) for end, (cost, audit, start, part) in best.items()}
        self.codes, self.rows = [], []

    def write(self, state: int, audit: str) -> tuple:
        """(hash, lines) after the block's part of the repaired conversation."""
        _, _, digest, lines = self.ways[state]
        digest, k = digest.copy(), 0
        for edit in audit:
            if edit != "D":
                initial = follows(state, "" if edit == "I" else self.codes[k], edit)
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[initial]
                role = self.rows[k][0] if edit == "K" else ROLES[initial].encode()
                digest.update((b"\n" if lines else b"") + role + b":")
                if edit != "I":
                    digest.update(self.rows[k][1])
                lines += 1
            k += edit != "I"
        return digest, lines

    def result(self) -> tuple:
        self.settle((NONE, ASSISTANT))
        cost, audit, digest, _ = min((w for w in self.ways.values()), key=lambda w: w[:2])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, *self.faults, self.illegal, cost, audit, digest.hexdigest()


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def last_sign(text: Column) -> Column:
    """The last character that isn't a space of the six ASCII kinds; empty where there is none."""
    return F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))


def prepared(turns: DataFrame, conv: str, turn: str, role: str, text: str, absent: str | None) -> DataFrame:
    """(conv, turn, role, text, initial, fault, present) of each row."""
    one = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    here = F.lit(True) if absent is None else ~F.coalesce(turns[absent], F.lit(False))
    rows = turns.select(turns[conv].alias("conv"), turns[turn].cast("long").alias("turn"), one(role).alias("role"), one(text).alias("text"), here.alias("present"))
    # nulls first, then by turn
    key = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    return rows.withColumns({"key": key, "digest": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), "sign": last_sign(F.col("text")), "initial": F.left("role", F.lit(1))})


def damaged(turns: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with faults put in by a hash of conv_id and turn, nulls as one space: of 20 rows one goes (absent), one is emptied,
    one loses its closing marks, one comes twice and one becomes the user's."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), (F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat((F.col("h") == 0).alias("absent"), F.when(F.col("h") == 3, 2).otherwise(1))).alias("absent")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times)


def repair_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", absent: str | None = None, block: int = 256, broadcast_rows: int = 200_000) -> DataFrame:
    """For each conversation: gaps, numbers of faults, the cost and audit of its cheapest repair, and the hash of the repaired turns.

    Turns go by turn (nulls first), those with the same one by role, then text; a null role or text is one space. Rows whose column
    `absent` is true only name their conversation. Null ids are one conversation. Edits: see the module's costs.
    A row that equals an earlier one of its conversation is found through the first turn of each text that comes at several turns,
    counted before the shuffle; equal rows of one turn follow each other. Then each conversation streams through one task in order, `block` turns at a
    time, so a conversation of any length takes the memory of one block and of its audit. Empty tables give no rows.
    """
    rows = prepared(turns, conv, turn, role, text, absent)
    firsts = rows.filter("present and sign <> ''").groupBy("conv", "digest").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    firsts = written(firsts.filter("first <> last").select(F.col("conv").alias("of"), "digest", "first"), "firsts")
    same = (F.col("of").eqNullSafe(F.col("conv"))) & (F.col("seen") == F.col("digest"))
    joined = rows.join(maybe_broadcast(firsts.withColumnRenamed("digest", "seen"), firsts.count(), broadcast_rows), same, "left")
    fault = F.when(F.col("sign") == "", 1).when(F.col("first") < F.col("key"), 2).when(~F.col("sign").isin(".", "!", "?"), 3).otherwise(0)
    joined = joined.select("conv", "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "initial", fault.alias("fault"), "present")
    kind = joined.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            types = [ids, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv", *RESULT])

        for batch in batches:
            ids = batch.column(0).type
            for conv_id, *rest, present in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv != conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = Repair(conv_id, block)
                if present:
                    now.add(*rest)
            if len(done) > 1000:
                yield out()
                done = []
        if now is not None:
            done.append(now.result())
            yield out()

    dealt = joined.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    fields = f"conv {kind.simpleString()}, " + ", ".join(f"{c} long" for c in RESULT[:6]) + ", audit string, repaired_sha256 string"
    return dealt.mapInArrow(run, fields).withColumnRenamed("conv", conv)


def repaired_turns(turns: DataFrame, repairs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations themselves: (conv, place, edit, role, text) of each turn that stays or is inserted, places from 0.

    An audit is taken apart into one row an edit; edits that have a turn meet it by its number in its conversation.
    """
    own = prepared(turns, conv, turn, role, text, None)
    number = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")) - 1
    own = own.select(F.col("conv").alias("of"), number.alias("number"), "role", "text")
    edits = repairs.select(F.col(conv).alias("conv"), F.posexplode(F.split("audit", "")).alias("at", "edit")).filter("edit <> ''")
    order = Window.partitionBy("conv").orderBy("at")
    edits = edits.withColumn("number", F.when(F.col("edit") != "I", F.count_if(F.col("edit") != "I").over(order) - 1))
    rows = edits.join(own, edits["conv"].eqNullSafe(own["of"]) & (edits["number"] == own["number"]), "left").filter("edit <> 'D'")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("place", F.row_number().over(order) - 1).withColumn("odd", F.count("*").over(whole) % 2)
    # an odd number of turns begins with a system turn; then users and assistants alternate
    given = F.when((F.col("place") - F.col("odd")) % 2 == 0, "user").otherwise("assistant")
    return rows.select(F.col("conv").alias(conv), "place", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(given).alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))
