"""Regex search over stored text through an index of trigrams.

``TextIndex`` keeps, for every block of 32 neighbouring rows of a Parquet table, the trigrams of one text
column: ``trigram, file_id, block``. Every index file is in order of the trigram, so that Parquet
statistics skip what a search does not ask for, and a frequent trigram spreads over all of them. The rows of a
block are read together, so building the index needs no shuffle.
A pattern states literal strings that every match must contain
(``required_trigrams``). Blocks with those trigrams are the candidates; only their files are read,
and the pattern itself decides on the texts of their rows.

* The index only ever spares work. A pattern that states nothing of three letters or more, or
  holds anything not read here (flags, look-around, back references, nested classes), scans the table.
* Files that came after the last ``refresh`` are scanned; files that have gone are not looked at. Rows are
  known by file and place in it, so keys may repeat or be null.
* Case is folded as the search folds it, for ASCII letters and the four signs beyond ASCII that match one.
  Other letters with case are left out of the requirement.
* Null, empty and short texts have no trigrams and no pattern with a requirement matches them. Very long
  texts are cut into overlapping pieces.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.functions import text as X
from chatterloom.session import ship_package

PIECE = 65_536
# Strings a run of literals and small groups may stand for, and trigrams looked up for each.
MOST_CHOICES, MOST_LOOKED_UP = 32, 4
BLOCK_ROWS = 32
# Signs beyond ASCII that a case-insensitive search takes for i, s and k.
LIKE_ASCII = {"\u0131": "i", "\u0130": "i", "\u017f": "s", "\u212a": "k"}
_SCHEMA = "trigram bigint, file_id bigint, block bigint"

Clause = frozenset[frozenset[str]]  # one of these sets of trigrams is there as a whole


class _Unread(Exception):
    """Something in a pattern that is not looked into."""


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _folded(char: str) -> str | None:
    """The indexed form of a literal; None for letters whose case is not folded in the index."""
    if char.isascii():
        return char.lower()
    return char if unicodedata.category(char) == "Lo" else None


class _Pattern:
    """What every match of a pattern contains: clauses, all of which hold."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        char = self.peek()
        if not char:
            raise _Unread
        self.at += 1
        return char

    def branches(self) -> tuple[set[str] | None, list[Clause]]:
        found = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            found.append(self.sequence())
        if len(found) == 1:
            return found[0]
        exact = [e for e, _ in found]
        if all(e is not None for e in exact) and len(set().union(*exact)) <= MOST_CHOICES:
            return set().union(*exact), []
        # A match goes through one branch: one clause of each, whichever states most.
        stated = [clauses + _clause(e) for e, clauses in found]
        if not all(stated):
            return None, []
        best = [max(clauses, key=lambda c: min(len(a) for a in c)) for clauses in stated]
        return None, [frozenset().union(*best)]

    def sequence(self) -> tuple[set[str] | None, list[Clause]]:
        run, clauses, whole = {""}, [], True
        while self.peek() not in ("", "|", ")"):
            choices, inner = self.atom()
            least, most = self.repeats()
            if choices is not None and least == most == 1 and len(run) * len(choices) <= MOST_CHOICES:
                run = {a + b for a in run for b in choices}
                continue
            whole = False
            if least and choices is not None and len(run) * len(choices) <= MOST_CHOICES:
                # The first repeat follows what came before, the last one leads to what comes next.
                clauses += _clause({a + b for a in run for b in choices})
                run = choices
                continue
            clauses += _clause(run) + (inner + _clause(choices) if least else [])
            run = {""}
        return (run, []) if whole else (None, clauses + _clause(run))

    def atom(self) -> tuple[set[str] | None, list[Clause]]:
        char = self.take()
        if char == "(":
            if self.peek() == "?":
                if self.text[self.at : self.at + 2] != "?:":
                    raise _Unread
                self.at += 2
            inside = self.branches()
            if self.take() != ")":
                raise _Unread
            return inside
        if char == "[":
            return self.char_class(), []
        if char == ".":
            return None, []
        if char in "^$":
            return self.nothing()
        if char == "\\":
            char = self.take()
            if char in "bBAzZ":
                return self.nothing()
            if char in "sSdDwW":
                return None, []
            char = {"t": "\t", "n": "\n", "r": "\r"}.get(char, char)
            if char.isalnum():
                raise _Unread
        elif char in "*+?{}])":
            raise _Unread
        kept = _folded(char)
        return (None if kept is None else {kept}), []

    def nothing(self) -> tuple[set[str], list[Clause]]:
        if self.peek() in tuple("*+?{"):
            raise _Unread
        return {""}, []

    def char_class(self) -> set[str] | None:
        inside = ""
        while (char := self.take()) != "]":
            if char in "[&\\":
                raise _Unread
            inside += char
        if not inside:
            raise _Unread
        kept = {_folded(c) for c in inside}
        return None if "-" in inside or "^" in inside or None in kept or len(kept) > 8 else kept

    def repeats(self) -> tuple[int, int | None]:
        char, bounds = self.peek(), (1, 1)
        if char in ("*", "+", "?"):
            self.at += 1
            bounds = {"*": (0, None), "+": (1, None), "?": (0, 1)}[char]
        elif char == "{":
            end = self.text.find("}", self.at)
            least, comma, most = self.text[self.at + 1 : max(end, self.at)].partition(",")
            if not least.isdecimal() or (most and not most.isdecimal()):
                raise _Unread
            self.at = end + 1
            bounds = (int(least), int(most) if most else None if comma else int(least))
        else:
            return bounds
        if self.peek() in ("?", "+"):
            self.at += 1
        if self.peek() in tuple("*+?{"):
            raise _Unread
        return bounds


def _clause(choices: set[str] | None) -> list[Clause]:
    if choices is None or any(len(c) < 3 for c in choices):
        return []
    return [frozenset(_trigrams(c) for c in choices)]


def required_trigrams(pattern: str) -> list[Clause]:
    """Clauses that the trigrams of every matching text meet; none where nothing is known."""
    found = _Pattern(pattern)
    try:
        exact, clauses = found.branches()
        if found.peek():
            raise _Unread
    except _Unread:
        return []
    return clauses + _clause(exact)


def _code(trigram: str) -> int:
    """A trigram as a number: 21 bits a sign."""
    first, second, third = map(ord, trigram)
    return first << 42 | second << 21 | third


def text_codes(text: str) -> np.ndarray:
    """Codes of the folded trigrams of a text, each one once; pieces bound the memory."""
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    signs[(signs >= ord("A")) & (signs <= ord("Z"))] += ord("a") - ord("A")
    for sign, plain in LIKE_ASCII.items():
        signs[signs == ord(sign)] = ord(plain)
    found = [np.empty(0, np.int64)]
    for low in range(0, len(signs) - 2, PIECE):
        piece = signs[low : low + PIECE + 2]
        found.append(np.unique(piece[:-2] << 42 | piece[1:-1] << 21 | piece[2:]))
    return found[1] if len(found) == 2 else np.unique(np.concatenate(found))


def _block_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams of every run of rows of one block; a block cut by a batch or a split comes in parts."""
    for batch in batches:
        files, blocks, texts = (batch.column(i) for i in range(3))
        at, codes = None, []
        for i in range(batch.num_rows + 1):
            here = (files[i].as_py(), blocks[i].as_py()) if i < batch.num_rows else None
            if here != at:
                if codes:
                    each = np.unique(np.concatenate(codes))
                    same = [pa.array(np.full(len(each), v, np.int64)) for v in at]
                    yield pa.RecordBatch.from_arrays([pa.array(each), *same], names=["trigram", "file_id", "block"])
                at, codes = here, []
            if here is not None:
                codes.append(text_codes(texts[i].as_py()))


def _spot() -> tuple[Column, Column]:
    """Where a row lies, for projections right over a scan."""
    return F.xxhash64(F.input_file_name()).alias("file_id"), F.expr(f"_metadata.row_index div {BLOCK_ROWS}").alias("block")


class TextIndex:
    """Trigrams of ``column`` of the Parquet table at ``table``, kept at ``path``."""

    def __init__(self, path: str, table: str, column: str):
        self.path, self.table, self.column = path.rstrip("/"), table, column

    def _read(self, spark: SparkSession, files: list[str]) -> DataFrame:
        whole = spark.read.parquet(self.table)
        if not files:
            return whole.limit(0)
        # Listed files are URLs, paths to read are not.
        return spark.read.schema(whole.schema).option("basePath", self.table).parquet(*[unquote(f) for f in files])

    def _known(self, spark: SparkSession) -> dict[str, int]:
        """Indexed files; the driver lists the table's files anyway."""
        try:
            return {r["file"]: r["file_id"] for r in spark.read.parquet(f"{self.path}/files").collect()}
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return {}
            raise

    def refresh(self, spark: SparkSession) -> int:
        """Index the files that are new; tells how many. A run that died is repeated, its rows do no harm."""
        known = self._known(spark)
        new = [f for f in spark.read.parquet(self.table).inputFiles() if f not in known]
        if not new:
            return 0
        read = self._read(spark, new)
        rows = read.select(*_spot(), F.col(self.column).alias("_text"))
        ship_package(spark)
        found = rows.filter(F.char_length("_text") >= 3).mapInArrow(_block_codes, _SCHEMA)
        # Rows of a block are read together, so there is nothing to bring together: every task sorts what it has.
        found.sortWithinPartitions("trigram", "file_id", "block").write.mode("append").parquet(f"{self.path}/trigrams")
        # Last, so that a file counts as indexed once all its trigrams are there. Names are those the rows came under.
        files = read.select(F.input_file_name().alias("file")).distinct().select("file", F.xxhash64("file").alias("file_id"))
        files.coalesce(1).write.mode("append").parquet(f"{self.path}/files")
        return len(new)

    def _looked_up(self, trigrams: DataFrame, clauses: list[Clause]) -> list[Clause]:
        """Of each set of trigrams the rarest few: fewer rows to meet, and the pattern decides anyway."""
        asked = {_code(t): t for clause in clauses for choice in clause for t in choice}
        counted = trigrams.filter(F.col("trigram").isin(sorted(asked))).groupBy("trigram").count()
        rows = dict.fromkeys(asked.values(), 0) | {asked[r["trigram"]]: r["count"] for r in counted.collect()}
        rarest = lambda choice: frozenset(sorted(choice, key=lambda t: (rows[t], t))[:MOST_LOOKED_UP])
        return [frozenset(rarest(choice) for choice in clause) for clause in clauses]

    def candidates(self, spark: SparkSession, pattern: str) -> DataFrame | None:
        """``file_id, block`` of the indexed rows that may match; None where all may."""
        clauses = required_trigrams(pattern)
        if not clauses or not self._known(spark):
            return None
        trigrams = spark.read.schema(_SCHEMA).parquet(f"{self.path}/trigrams")
        clauses = self._looked_up(trigrams, clauses)
        asked = sorted({_code(t) for clause in clauses for choice in clause for t in choice})
        has = lambda t: F.array_contains("_has", F.lit(_code(t)).cast("bigint"))

        def holds(clause: Clause) -> Column:
            each = [_all(has(t) for t in sorted(choice)) for choice in clause]
            return F.greatest(F.lit(False), *each)

        # A block has at most as many trigrams here as the pattern asks for.
        met = trigrams.filter(F.col("trigram").isin(asked)).groupBy("file_id", "block").agg(F.collect_set("trigram").alias("_has"))
        return met.filter(_all(holds(c) for c in clauses)).select("file_id", "block")

    def search(self, spark: SparkSession, pattern: str) -> DataFrame:
        """Rows of the table whose column matches, as a scan would find them."""
        table = spark.read.parquet(self.table)
        matching = X.matches(F.col(self.column), pattern)
        found = self.candidates(spark, pattern)
        if found is None:
            return table.filter(matching) if pattern else table
        known, current = self._known(spark), table.inputFiles()
        hit = {r["file_id"] for r in found.select("file_id").distinct().collect()}  # at most the table's files
        read = self._read(spark, [f for f in current if known.get(f) in hit])
        numbered = read.select(F.struct("*").alias("_row"), *_spot())
        kept = numbered.join(found, ["file_id", "block"], "left_semi")
        indexed = kept.select("_row.*").filter(matching)
        rest = self._read(spark, [f for f in current if f not in known]).filter(matching)
        return indexed.unionByName(rest)


def _all(conditions: Iterator[Column]) -> Column:
    return F.least(F.lit(True), *conditions)
