r"""Repair of conversations by Knuth's lightest derivation.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles: perhaps a
system turn, then user and assistant in turn. Its turns are taken in order; the
first fault of each counts:

* blank: no character but white space (``[\x20\x09-\x0D]``);
* duplicate: a turn of this role and text came before;
* truncated: the last character that is no white space is none of ``.!?``.

A repair is a string of edits, its *audit*: K keeps a turn (0), R gives it the role
user or assistant (3), D deletes it (4; blank and duplicate turns must go), I puts
in an empty turn of the user or the assistant (3). A truncated turn that stays
adds 3. The lightest repair has the least cost and, among those, the audit least in
ASCII.

Items are [turns read, state], a state being what the roles so far allow next:
0 nothing yet, 1 after the system turn, 2 after a user, 3 after an assistant. An
item and an edit deduce the next item, with weight (cost + w, audit + letter). That
function is superior (no result is lighter than the item it comes from) and
monotone: audits of equal cost that lead to the same item are never prefixes of
each other, since one that goes on from the other can only add inserts, which
cost. So the agenda pops items lightest first, an item is final when it is
popped, and the first goal popped is the lightest repair. The state says which role
an R or I gives, so an audit stands for one repair.

Audits are strings of the length of the conversation. To keep them short, one
longer than ``BLOCK`` turns is derived in blocks: the lightest way through each
block, for each state before and after it, then an agenda over [blocks read, state].

Turns are numbered in Spark, and faults found there; a task sees a conversation
as one byte a turn. Repaired turns are written out in order and hashed as they pass.
A conversation's audit and digest are one string and one hash, so one task reads
its turns in order, but none holds more than its bytes.

Defined cases: null roles and texts are empty; a role of another initial, or
none, can only be changed or go; turns go by number, nulls first, then role, then text;
rows without a key are one conversation; repeated rows are turns of their own;
other columns are ignored; keys are of any type that sorts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatterloom.session import ship_package, written

SPACE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK = 256
ROLES = {"u": "user", "a": "assistant"}

# A turn's byte: which initial it has, and 4 times its fault.
OTHER, SYSTEM, USER, ASSISTANT = range(4)
FINE, BLANK, DUPLICATE, CUT = range(4)
_KEPT = {(0, SYSTEM): 1, (0, USER): 2, (1, USER): 2, (3, USER): 2, (2, ASSISTANT): 3}  # a state after a turn of this initial
_GIVEN = (2, 2, 3, 2)  # the state after a role that an edit gives

Weight = tuple[int, str]


# --- agenda --------------------------------------------------------------------------


def lightest(
    axioms: Iterable[tuple[object, Weight]], deductions: Callable, goals: Callable[[object], bool], first: bool = True
) -> dict[object, Weight]:
    """Weights of the goal items, or of only the first one popped. ``deductions(item)`` gives (item, cost, letters)."""
    agenda: list = []
    for item, (cost, audit) in axioms:
        heappush(agenda, (cost, audit, item))
    final, reached = set(), {}
    while agenda:
        cost, audit, item = heappop(agenda)
        if item in final:
            continue
        final.add(item)
        if goals(item):
            reached[item] = cost, audit
            if first:
                break
        for head, more, letters in deductions(item):
            if head not in final:
                heappush(agenda, (cost + more, audit + letters, head))
    return reached


def _edits(turns: bytes) -> Callable:
    def deductions(item: tuple[int, int]) -> Iterator[tuple]:
        i, state = item
        yield (i, _GIVEN[state]), INSERT, "I"
        if i == len(turns):
            return
        fault, initial = divmod(turns[i], 4)
        yield (i + 1, state), DELETE, "D"
        if fault in (BLANK, DUPLICATE):
            return
        extra = TRUNCATED if fault == CUT else 0
        if (state, initial) in _KEPT:
            yield (i + 1, _KEPT[state, initial]), KEEP + extra, "K"
        yield (i + 1, _GIVEN[state]), REROLE + extra, "R"

    return deductions


@lru_cache(4096)
def _through(turns: bytes, state: int) -> tuple[tuple[int, Weight], ...]:
    """The lightest way from a state through a block to each state after it."""
    ways = lightest([((0, state), (0, ""))], _edits(turns), lambda item: item[0] == len(turns), first=False)
    return tuple((item[1], weight) for item, weight in ways.items())


def lightest_repair(turns: bytes, block: int = BLOCK) -> Weight:
    """Cost and audit for the bytes of a conversation's turns."""
    blocks = [turns[i : i + block] for i in range(0, len(turns), block)]

    def deductions(item: tuple[int, int]) -> Iterator[tuple]:
        i, state = item
        if i < len(blocks):
            for after, (cost, audit) in _through(blocks[i], state):
                yield (i + 1, after), cost, audit

    goal = lightest([((0, 0), (0, ""))], deductions, lambda item: item[0] == len(blocks) and item[1] in (0, 3))
    return next(iter(goal.values()))


_solved = lru_cache(4096)(lightest_repair)


def steps(turns: bytes, audit: str) -> Iterator[tuple[int, str]]:
    """Where an audit does anything but keep: (turn, letters), ``u`` and ``a`` for roles put in, then
    ``K``, ``D`` or the role's capital for the turn itself. Turn ``len(turns)`` stands for the end."""
    i, state, letters = 0, 0, ""
    for edit in audit:
        if edit == "I":
            letters += "ua"[_GIVEN[state] - 2]
            state = _GIVEN[state]
            continue
        if edit == "K":
            state = _KEPT[state, turns[i] % 4]
        elif edit == "R":
            state = _GIVEN[state]
        if edit != "K" or letters:
            yield i, letters + ("UA"[state - 2] if edit == "R" else edit)
        i, letters = i + 1, ""
    if letters:
        yield i, letters


# --- tasks ---------------------------------------------------------------------------


class _Talk:
    """What is kept of a conversation while its turns pass in order."""

    def __init__(self, key: pa.Array):
        self.key, self.turns = key, bytearray()
        self.low = self.high = None
        self.numbers = 0

    def add(self, turns: bytes, numbers: np.ndarray) -> None:
        self.turns += turns
        if len(numbers):
            if self.low is None:
                self.low, self.numbers = int(numbers[0]), 1
            elif numbers[0] != self.high:
                self.numbers += 1
            self.numbers += int(np.count_nonzero(numbers[1:] != numbers[:-1]))
            self.high = int(numbers[-1])

    def gaps(self) -> int:
        return self.high - self.low + 1 - self.numbers if self.low is not None else 0

    def report(self) -> tuple:
        code = np.frombuffer(bytes(self.turns), np.uint8)
        faults = np.bincount(code // 4, minlength=4)
        before, after = code[:-1] % 4, code[1:] % 4
        legal = (after == USER) & ((before == SYSTEM) | (before == ASSISTANT)) | (after == ASSISTANT) & (before == USER)
        return self.gaps(), *(int(faults[f]) for f in (BLANK, DUPLICATE, CUT)), int(np.count_nonzero(~legal))


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over turns in order: a report of each conversation (``n`` null) and the steps that change it."""
    talk = None

    def finished(talks: list[_Talk]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(talks), 1024):
            keys, rows = [], []
            for t in talks[at : at + 1024]:
                turns = bytes(t.turns)
                cost, audit = (_solved if len(turns) <= BLOCK else lightest_repair)(turns)
                rows.append((None, None, *t.report(), cost, audit))
                changed = [(n + 1, letters, *[None] * 7) for n, letters in steps(turns, audit)]
                rows += changed
                keys += [t.key] * (1 + len(changed))
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(keys), *columns], names=names)

    names = ["k", "n", "letters", *[c.strip().split()[0] for c in _REPORT.split(",")]]
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6, pa.string()]
    for batch in batches:
        if not batch.num_rows:
            continue
        n, code = batch.column(1).to_numpy(), batch.column(3).to_numpy().astype(np.uint8)
        turn = batch.column(2)
        given, known = turn.fill_null(0).to_numpy(), turn.is_valid().to_numpy(zero_copy_only=False)
        cuts, done = [0, *np.flatnonzero(n[1:] == 1) + 1, len(n)], []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if n[lo] == 1:
                if talk:
                    done.append(talk)
                talk = _Talk(batch.column(0).slice(lo, 1))
            talk.add(code[lo:hi].tobytes(), given[lo:hi][known[lo:hi]])
        yield from finished(done)
    if talk:
        yield from finished([talk])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the turns in order, each behind the letters that change it: the repaired turns."""
    letters, position = None, 0
    for batch in batches:
        at, roles, texts, positions = [], [], [], []
        columns = (batch.column(c).to_pylist() for c in range(1, 6))
        for i, (n, is_turn, mark, role, text) in enumerate(zip(*columns)):
            if n == 0:  # opens a conversation
                position = 0
                continue
            if is_turn:
                edit = letters[-1] if letters else "K"
                letters = None
                out = [] if edit == "D" else [(role if edit == "K" else ROLES[edit.lower()], text)]
            else:
                out = [(ROLES[x], "") for x in mark if x in ROLES]
                letters = mark if mark[-1] not in ROLES else None
            for role, text in out:
                position += 1
                at.append(i)
                roles.append(role)
                texts.append(text)
                positions.append(position)
        if at:
            made = [pa.array(positions, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *made], names=["k", "position", "role", "text"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ``role:text`` lines of each conversation, as they pass."""
    key, sha = None, None
    for batch in batches:
        keys, digests = [], []
        rows = zip(*(batch.column(c).to_pylist() for c in range(1, 4)))
        for i, (position, role, text) in enumerate(rows):
            if position == 1:
                if sha:
                    keys.append(key)
                    digests.append(sha.hexdigest())
                key, sha = batch.column(0).slice(i, 1), hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        if keys:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(digests)], names=["k", "sha"])
    if sha:
        yield pa.RecordBatch.from_arrays([key, pa.array([sha.hexdigest()])], names=["k", "sha"])


# --- operator ------------------------------------------------------------------------


def _code(role: Column, text: Column, again: Column) -> Column:
    """The byte of a turn; ``again`` says whether its role and text came before."""
    said = F.rtrim(text, F.lit(SPACE))
    fault = (
        F.when(said == "", BLANK).when(again, DUPLICATE).when(~F.substring(said, -1, 1).isin(".", "!", "?"), CUT).otherwise(FINE)
    )
    initial = F.substring(role, 1, 1)
    return F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER) + 4 * fault


class Repair:
    """``reports``: a row per conversation; ``turns()``: its repaired turns; ``digests()``: their SHA-256."""

    def __init__(
        self, turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
    ):
        ship_package(turns.sparkSession)
        plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
        given = turns.select(F.col(key).alias("k"), F.col(turn).cast("bigint").alias("turn"),
                             plain(role).alias("role"), plain(text).alias("text"))
        said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
        in_order = Window.partitionBy("k").orderBy(F.asc_nulls_first("turn"), "role", "text")
        numbered = given.withColumn("n", F.row_number().over(in_order).cast("bigint")).withColumn("said", said)
        again = F.row_number().over(Window.partitionBy("k", "said").orderBy("n")) > 1
        self.key, self.kind = key, given.schema["k"].dataType
        self.given = written(
            numbered.withColumn("again", again).select(
                "k", "n", "turn", _code(F.col("role"), F.col("text"), F.col("again")).alias("code"), "role", "text"
            ),
            "turns",
        )
        thin = self.given.select("k", "n", "turn", "code").repartition("k").sortWithinPartitions("k", "n")
        fields = T.StructType([T.StructField("k", self.kind)]).add("n", "long").add("letters", "string")
        report = T._parse_datatype_string(_REPORT)
        self.derived = written(thin.mapInArrow(_derive, T.StructType([*fields, *report])), "derivations")
        self.reports = self.derived.filter("n IS NULL").select(F.col("k").alias(key), *report.names)

    def _repaired(self) -> DataFrame:
        none = F.lit(None).cast("string")
        said = self.given.select("k", "n", F.lit(True).alias("is_turn"), none.alias("letters"), "role", "text")
        marks = self.derived.filter("n IS NOT NULL").select(
            "k", "n", F.lit(False).alias("is_turn"), "letters", none.alias("role"), none.alias("text")
        )
        opened = self.derived.filter("n IS NULL").select(
            "k", F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("is_turn"), none.alias("letters"), none.alias("role"), none.alias("text")
        )
        together = said.unionByName(marks).unionByName(opened).repartition("k").sortWithinPartitions("k", "n", "is_turn")
        fields = [T.StructField("k", self.kind), T.StructField("position", T.LongType())]
        fields += [T.StructField(c, T.StringType()) for c in ("role", "text")]
        return together.mapInArrow(_apply, T.StructType(fields))

    def turns(self) -> DataFrame:
        """``key, position, role, text`` of the repaired conversations, positions from 1."""
        return self._repaired().withColumnRenamed("k", self.key)

    def digests(self) -> DataFrame:
        """``key, repaired_sha256`` of conversations that have turns left."""
        fields = T.StructType([T.StructField("k", self.kind), T.StructField("sha", T.StringType())])
        return self._repaired().mapInArrow(_digest, fields).toDF(self.key, "repaired_sha256")


def repaired(turns: DataFrame, **columns: str) -> DataFrame:
    """``key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``, a row per conversation."""
    made = Repair(turns, **columns)
    key = made.key
    digests = made.digests().withColumnRenamed(key, "_of")
    same = made.reports[key].eqNullSafe(digests["_of"])
    empty = F.sha2(F.lit(""), 256)
    return made.reports.join(digests, same, "left").select(
        *made.reports.columns, F.coalesce("repaired_sha256", empty).alias("repaired_sha256")
    )
