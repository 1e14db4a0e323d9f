"""Repair of conversations: the cheapest edits that let roles take turns again.

The turns of a conversation become codes, and a depth-first branch-and-bound search finds the
edits: an explicit stack of prefixes, a lower bound on what any suffix still costs, an
incumbent of (cost, audit), and for every node (turn, state of the grammar) a table of the
best prefix that reached it, which eliminates worse ones. The search ends when the stack is
empty, so the incumbent is proved to be the cheapest and, among the cheapest, the least audit.

Conversations of up to ``SHORT`` rows and ``BYTES`` bytes are solved whole, dealt by identifier.
Longer ones are ordered by ranges, cut into pieces of ``PIECE`` turns, and searched piece by
piece for every state before and after; one pass over these results, which are as
long as the audit, joins them. Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import materialize, numbered

#: Rows and bytes of the longest conversation that one call handles whole.
SHORT = 1000
BYTES = 4 << 20
#: Turns of a piece of a longer one.
PIECE = 1024
#: Rows of an Arrow batch that leaves a worker.
ROWS = 4096

# What the edits cost, and a truncated row that stays.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1

#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = frozenset({START, ASSISTANT})
STATES = (START, SYSTEM, USER, ASSISTANT)
#: After the next turn of a user or assistant, whichever is due.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_DUE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}

_BLANK = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def _edits(code: str, state: int) -> list[tuple[str, int, int]]:
    """Edits of one turn in a state: letter, cost, state after it.

    Codes: x and y must go; s, u, a, o are turns of system, user, assistant and others, in upper
    case if truncated.
    """
    found = [("D", DELETE, state)]
    if code in "xy":
        return found
    role, extra = code.lower(), TRUNCATED * code.isupper()
    if role == "s" and state == START:
        found.append(("K", extra, SYSTEM))
    if role == _DUE[state][0]:
        found.append(("K", extra, _NEXT[state]))
    found.append(("R", REROLE + extra, _NEXT[state]))
    return found


_EDITS = {(code, state): _edits(code, state) for code in "xysuaoSUAO" for state in STATES}
_ENDLESS = 1 << 60


def _bounds(codes: str, ends: frozenset[int]) -> list[list[int]]:
    """For every turn and state the least that the turns from there on cost, whatever the audit."""
    least = [0 if state in ends else _ENDLESS for state in STATES]
    found = []
    for code in [*codes, None][::-1]:
        if code is not None:
            least = [min(cost + least[after] for _, cost, after in _EDITS[code, state]) for state in STATES]
        for _ in range(2):  # two insertions reach every state that more would
            least = [min(least[state], INSERT + least[_NEXT[state]]) for state in STATES]
        found.append(least)
    return found[::-1]


def search(codes: str, start: int = START, ends: frozenset[int] = ENDS) -> tuple[int, str] | None:
    """Cost and audit of the cheapest edits of ``codes`` that lead from ``start`` to one of ``ends``,
    the ASCII-least audit among the cheapest; None if no edits do."""
    bounds = _bounds(codes, ends)
    incumbent = None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        bound = cost + bounds[at][state]
        if bound >= _ENDLESS or incumbent and (bound, audit) > (incumbent[0], incumbent[1][: len(audit)]):
            continue
        if reached.get((at, state), (_ENDLESS, "")) <= (cost, audit):
            continue
        reached[at, state] = cost, audit
        if at == len(codes) and state in ends and (incumbent is None or (cost, audit) < incumbent):
            incumbent = cost, audit
        steps = [("I", INSERT, _NEXT[state], at)]
        if at < len(codes):
            steps += [(*edit, at + 1) for edit in _EDITS[codes[at], state]]
        # The most promising on top, the least letter first among equals.
        steps.sort(key=lambda x: (x[1] + bounds[x[3]][x[2]], x[0]), reverse=True)
        stack += [(then, after, cost + more, audit + letter) for letter, more, after, then in steps]
    return incumbent


@lru_cache(10_000)
def _known(codes: str) -> tuple[int, str]:
    return search(codes)


@lru_cache(100)
def _ways(codes: str) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of all cheapest ways through a piece."""
    return [
        (start, end, *found)
        for start in STATES
        for end in STATES
        if (found := search(codes, start, frozenset({end})))
    ]


def steps(codes: Iterator[str], audit: str) -> Iterator[tuple[int, str, str | None]]:
    """What an audit leaves: place of the turn (-1 for an inserted one), letter, new role or None.

    y stands in the place of the turn before it.
    """
    state, at = START, -1
    codes = iter(codes)
    for letter in audit:
        if letter == "I":
            yield -1, letter, _DUE[state]
            state = _NEXT[state]
            continue
        code = next(codes)
        at += code != "y"
        if letter == "R":
            yield at, letter, _DUE[state]
            state = _NEXT[state]
        elif letter == "K":
            yield at, letter, None
            state = SYSTEM if code in "sS" else _NEXT[state]


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` after the faults that a hash of identifier and turn plants.

    ``copies`` is 0 for a dropped row, 2 for a repeated one, else 1. NULLs count as one blank, but
    ``conv_id`` and ``turn`` stay NULL.
    """
    blank = F.lit(" ")
    name = [F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20
    text = F.coalesce("text", blank)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form that ``damage`` returns."""
    blank = F.lit(" ")
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
        F.lit(1).alias("copies"),
    )


def _first_letter(role: Column) -> Column:
    letter = F.substring(role, 1, 1)
    return F.when(letter.isin("s", "u", "a"), letter).otherwise("o")


def _coded(rows: DataFrame) -> DataFrame:
    """``rows`` with ``code``, x for a blank text, and a digest of the text."""
    letter = _first_letter(F.col("role"))
    code = (
        F.when(~F.col("text").rlike(_BLANK), "x")
        .when(F.col("text").rlike(_ENDED), letter)
        .otherwise(F.upper(letter))
    )
    return rows.select("*", letter.alias("letter"), code.alias("code"), F.sha2("text", 256).alias("digest"))


REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string"
)


class _Tally:
    """Counts over the rows of a conversation in order."""

    def __init__(self) -> None:
        self.first = self.last = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, letter: str, fault: str, copies: int = 1) -> None:
        """A row; its further copies are duplicates, unless blank."""
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        if self.before is not None and self.before + letter not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = letter
        self.illegal += copies - 1
        if fault == "blank":
            self.blank += copies
        else:
            self.duplicate += copies - 1
            if fault == "duplicate":
                self.duplicate += 1
            elif fault == "truncated":
                self.truncated += 1

    def values(self) -> tuple[int, int, int, int, int]:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


def _fault(code: str, duplicate: bool) -> str:
    if code == "x":
        return "blank"
    return "duplicate" if duplicate else "truncated" if code.isupper() else ""


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = ROWS) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, field.type) for column, field in zip(zip(*some), schema)], schema=schema
        )


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(name).to_pylist() for name in names])


_TURNS = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
_SHORT = pa.schema([
    ("conv_id", pa.int64()), *[(name, pa.int64()) for name in
    ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("turns", _TURNS),
])


def _solve_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation, from rows sorted by conversation and turn."""

    def solved() -> Iterator[tuple]:
        every = _rows(batches, "conv_id", "turn", "role", "text", "copies", "letter", "code")
        for conv_id, rows in groupby(every, lambda row: row[0]):
            tally, seen, codes, kept = _Tally(), set(), [], []
            for _, turn, role, text, copies, letter, code in rows:
                if not copies:
                    continue
                fault = _fault(code, (role, text) in seen)
                seen.add((role, text))
                tally.add(turn, letter, fault, copies)
                codes.append("x" if fault in ("blank", "duplicate") else code)
                codes.append("y" * (copies - 1))
                kept.append((role, text))
            codes = "".join(codes)
            cost, audit = _known(codes)
            turns = [
                {"edit": letter, "role": new or kept[at][0], "text": kept[at][1] if at >= 0 else ""}
                for at, letter, new in steps(codes, audit)
            ]
            yield conv_id, *tally.values(), cost, audit, turns

    yield from _batches(solved(), _SHORT, 256)


def _short(rows: DataFrame) -> DataFrame:
    """REPORT and ``turns`` (edit, role, text) of each conversation, dealt by identifier."""
    ordered = (
        _coded(rows)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "digest")
        .select("conv_id", "turn", "role", "text", "copies", "letter", "code")
    )
    return ordered.mapInArrow(
        _solve_short, f"{REPORT}, turns array<struct<edit:string,role:string,text:string>>"
    )


_PIECES = pa.schema([
    ("conv_id", pa.int64()), ("start", pa.int64()), ("part", pa.int64()), ("codes", pa.string()),
    ("states", pa.list_(pa.int64())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
    *[(name, pa.int64()) for name in ("blank", "duplicate", "truncated", "illegal", "turns")],
    ("first", pa.int64()), ("last", pa.int64()), ("head", pa.string()), ("tail", pa.string()),
])
_PIECES_DDL = (
    "conv_id long, start long, part long, codes string, states array<long>, costs array<long>, "
    "audits array<string>, blank long, duplicate long, truncated long, illegal long, turns long, "
    "first long, last long, head string, tail string"
)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of conversations, from rows sorted by rank; a piece stays inside its block of ranks."""

    def pieces() -> Iterator[tuple]:
        every = _rows(batches, "conv_id", "rank", "turn", "letter", "code", "copies", "duplicate")
        for (conv_id, _), rows in groupby(every, lambda row: (row[0], row[1] // PIECE)):
            tally, codes, start, head = _Tally(), [], None, None
            for _, rank, turn, letter, code, copies, duplicate in rows:
                start = rank if start is None else start
                head = head or letter
                fault = _fault(code, duplicate)
                tally.add(turn, letter, fault, copies)
                codes.append("x" if fault in ("blank", "duplicate") else code)
                codes.append("y" * (copies - 1))
            codes = "".join(codes)
            counts = (tally.blank, tally.duplicate, tally.truncated, tally.illegal, tally.turns)
            # Copies can make a piece long: it is solved in parts, and the first one counts.
            for part, at in enumerate(range(0, len(codes), PIECE)):
                some = codes[at : at + PIECE]
                ways = _ways(some)
                yield (
                    conv_id, start, part, some,
                    [4 * before + after for before, after, _, _ in ways],
                    [cost for _, _, cost, _ in ways], [audit for *_, audit in ways],
                    *(counts if part == 0 else (0,) * 5), tally.first, tally.last, head, tally.before,
                )

    yield from _batches(pieces(), _PIECES, 16)


class _Chain:
    """The best (cost, audit) for each state after the pieces so far; what all audits share of
    their beginning is kept once."""

    def __init__(self) -> None:
        self.shared: list[str] = []
        self.best: dict[int, tuple[int, str]] = {START: (0, "")}

    def add(self, states: list[int], costs: list[int], audits: list[str]) -> None:
        found: dict[int, tuple[int, str]] = {}
        for pair, cost, audit in zip(states, costs, audits):
            before, after = divmod(pair, 4)
            if before in self.best:
                total = self.best[before][0] + cost
                if after not in found or total <= found[after][0]:
                    way = total, self.best[before][1] + audit
                    found[after] = min(found.get(after, way), way)
        prefix = os.path.commonprefix([audit for _, audit in found.values()])
        self.shared.append(prefix)
        self.best = {state: (cost, audit[len(prefix) :]) for state, (cost, audit) in found.items()}

    def result(self) -> tuple[int, str]:
        cost, audit = min(self.best[state] for state in ENDS if state in self.best)
        return cost, "".join([*self.shared, audit])


_LONG = pa.schema([
    ("conv_id", pa.int64()), *[(name, pa.int64()) for name in
    ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()),
    ("step", pa.int64()), ("rank", pa.int64()), ("edit", pa.string()), ("role", pa.string()),
])


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of REPORT per conversation, then a row per turn that its audit leaves."""

    def joined() -> Iterator[tuple]:
        names = _PIECES.names
        for conv_id, pieces in groupby(_rows(batches, *names), lambda row: row[0]):
            chain, codes, ranks = _Chain(), [], []
            counts, turns, first, last, tail, start = [0, 0, 0, 0], 0, None, None, None, None
            for row in pieces:
                piece = dict(zip(names, row))
                chain.add(piece["states"], piece["costs"], piece["audits"])
                codes.append(piece["codes"])
                start = piece["start"] if start is None else start
                if piece["part"]:
                    continue
                for i, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
                    counts[i] += piece[name]
                if tail and tail + piece["head"] not in ("su", "ua", "au"):
                    counts[3] += 1
                tail = piece["tail"]
                turns += piece["turns"]
                if piece["first"] is not None:
                    turns -= piece["first"] == last
                    first = piece["first"] if first is None else first
                    last = piece["last"]
            gaps = 0 if first is None else last - first + 1 - turns
            cost, audit = chain.result()
            yield conv_id, gaps, *counts, cost, audit, None, None, None, None
            every = (code for some in codes for code in some)
            for step, (at, letter, new) in enumerate(steps(every, audit)):
                yield conv_id, *[None] * 7, step, start + at if at >= 0 else None, letter, new

    yield from _batches(joined(), _LONG)


def _long(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """REPORT of each conversation, and its repaired turns (conv_id, position, edit, role, text)."""
    alike = rows.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(
        F.sum("copies").alias("copies")
    )
    order = ["conv_id", "turn", "role", "digest"]
    ordered = materialize(numbered(_coded(alike), *order), "repair-ordered")
    light = ordered.select("conv_id", "rank", "turn", "role", "letter", "code", "copies", "digest")
    # A turn is a duplicate if its role and text stand earlier; equal rows are copies already.
    firsts = light.groupBy("conv_id", "role", "digest").agg(F.min("rank").alias("rank"))
    flagged = light.drop("role", "digest").join(
        firsts.select("rank", F.lit(False).alias("duplicate")), "rank", "left"
    )
    pieces = materialize(
        flagged.withColumn("duplicate", F.coalesce("duplicate", F.lit(True)))
        .repartition(F.floor(F.col("rank") / PIECE))
        .sortWithinPartitions("rank")
        .select("conv_id", "rank", "turn", "letter", "code", "copies", "duplicate")
        .mapInArrow(_cut, _PIECES_DDL),
        "repair-pieces",
    )
    joined = materialize(
        pieces.repartition("conv_id")
        .sortWithinPartitions("conv_id", "start", "part")
        .mapInArrow(_join_pieces, f"{REPORT}, step long, rank long, edit string, role string"),
        "repair-joined",
    )
    texts = ordered.select("rank", F.col("role").alias("own"), "text")
    turns = joined.where("step IS NOT NULL").select("conv_id", "step", "rank", "edit", "role")
    kept = turns.where("rank IS NOT NULL").join(texts, "rank").select(
        "conv_id", F.col("step").alias("position"), "edit", F.coalesce("role", "own").alias("role"), "text"
    )
    added = turns.where("rank IS NULL").select(
        "conv_id", F.col("step").alias("position"), "edit", "role", F.lit("").alias("text")
    )
    return joined.where("step IS NULL").select(*[part.split()[0] for part in REPORT.split(", ")]), kept.union(added)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the turns of each conversation, read one after the other."""
    def digests() -> Iterator[tuple]:
        for conv_id, rows in groupby(_rows(batches, "conv_id", "role", "text"), lambda row: row[0]):
            digest, between = hashlib.sha256(), ""
            for _, role, text in rows:
                digest.update(f"{between}{role}:{text}".encode())
                between = "\n"
            yield conv_id, digest.hexdigest()

    yield from _batches(digests(), pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))


def _split(rows: DataFrame, short: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of short conversations, and those of long ones if there are any."""
    long = materialize(
        rows.groupBy("conv_id")
        .agg(F.sum(F.greatest("copies", F.lit(1))).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
        .where((F.col("n") > short) | (F.col("bytes") > BYTES))
        .select(F.col("conv_id").alias("long_id")),
        "repair-long",
    )
    if long.isEmpty():
        return rows, None
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    return rows.join(long, same, "left_anti"), rows.join(long, same, "left_semi")


def repair(rows: DataFrame, short: int = SHORT) -> DataFrame:
    """(conv_id, position, edit, role, text): the repaired turns of every conversation.

    ``rows`` come from ``damage`` or ``undamaged``. ``edit`` is K, R or I; position counts from 0.
    """
    small, large = _split(rows, short)
    found = _short(small).select("conv_id", F.posexplode("turns").alias("position", "turn")).select(
        "conv_id", F.col("position").cast("long").alias("position"), "turn.edit", "turn.role", "turn.text"
    )
    return found if large is None else found.unionByName(_long(large)[1])


def report(rows: DataFrame, short: int = SHORT) -> DataFrame:
    """Faults, cost, audit and a digest of the repaired turns of every conversation.

    Turns are taken in order, NULL ones first, rows of one turn by role and then by digest of the
    text; a NULL ``conv_id`` is a conversation of its own. Faults are counted over the rows with
    copies: a blank text, else a role and text that stand earlier, else a text that does not
    end in a full stop, exclamation or question mark. A conversation whose rows are all
    dropped has zeros, an empty audit and the digest of an empty text. An empty table gives an
    empty result. Other columns, whatever their names, are not read.
    """
    small, large = _split(rows, short)
    line = lambda turn: F.concat(turn["role"], F.lit(":"), turn["text"])
    found = _short(small).withColumn(
        "repaired_sha256", F.sha2(F.array_join(F.transform("turns", line), "\n"), 256)
    ).drop("turns")
    if large is None:
        return found
    totals, turns = _long(large)
    digests = (
        turns.repartition("conv_id")
        .sortWithinPartitions("conv_id", "position")
        .mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
        .withColumnRenamed("conv_id", "of")
    )
    nothing = F.sha2(F.lit(""), 256)
    totals = totals.join(digests, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    return found.unionByName(totals.withColumn("repaired_sha256", F.coalesce("repaired_sha256", nothing)))


def digests(conversations: DataFrame) -> DataFrame:
    """``report`` of ``conversations`` (conv_id, turn, role, text) after ``damage``."""
    return report(damage(conversations))
