"""Structure repair of conversations: faults, and the cheapest edits to alternating turns, by iterative-deepening A*.

A conversation's rows are edited in order: Keep (0), Rerole to user or assistant (3), Delete (4) or Insert
an empty user or assistant row (3), so that the role initials read ``(s?(ua)+)?``.  Blank and duplicate rows
must go; a truncated row that stays costs 3 more.  Where the turns stand (after nothing, s, u or a) says which
role an inserted or reroled row gets, so the letters of the edits, D, I, K and R, say everything.

The search goes depth first in the order of the letters, under a bound of cost that is raised to the least
cost that the last pass couldn't refute.  The transposition table keeps, for a place and state that failed,
the least cost that is left from there; it prunes later visits and passes.  So the first accepting
path under the first bound that has one is the cheapest, and the ASCII-least of those.

Conversations are cut into segments of ``SEGMENT`` rows, which end just after a row is used: a segment is
searched for each pair of states at its ends, and the best chain of segments is put together in
order.  No chain's letters begin another's of the same rows, so the least pieces make the least whole.  A
conversation of any length is searched in parts by many tasks; only its letters meet in one, and its
repaired rows, which pass as a sorted stream, as the digest of a whole text has to.

Null role and text count as one space; rows of null conv_id are one conversation.  Rows are taken by
turn, nulls first, ties by role and text.  Repeated rows are duplicates.  An empty table gives an empty
table; other columns of the input are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ordered, partitions_for, scan, small_batches

SEGMENT = 128
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = "sua"
FINE, BLANK, DUPLICATE, CUT_SHORT = range(4)
#: State after an initial: 0 nothing, 1 s, 2 u, 3 a; what an inserted or reroled row is in each state, and which state it leads to.
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
LEGAL = {"su", "ua", "au"}
INFINITE = 1 << 40
_SPACE = r"\x20\x09-\x0D"

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


# ---- search -----------------------------------------------------------------------------------------


class Search:
    """Cheapest edits of a run of rows, (initial, fault) each, to a state in ``goals``.

    ``tail``: rows may be inserted behind the last one.
    """

    def __init__(self, rows: list[tuple[str, int]], goals: set[int], tail: bool) -> None:
        self.rows, self.goals, self.tail, self.n = rows, goals, tail, len(rows)
        self.left = [0] * (self.n + 1)  # what the faults alone cost from here on
        for k in range(self.n - 1, -1, -1):
            fault = rows[k][1]
            self.left[k] = self.left[k + 1] + (DELETE if fault in (BLANK, DUPLICATE) else TRUNCATED if fault == CUT_SHORT else 0)
        self.last_s = max((k for k, r in enumerate(rows) if r[0] == "s" and r[1] not in (BLANK, DUPLICATE)), default=-1)
        self.low: dict[tuple[int, int], int] = {}  # transposition table: proven least cost from (row, state)
        self.visits = 0

    def least(self, at: int, state: int) -> int:
        """No edit leads back to state 0, and only a system row that is kept to state 1."""
        if self.goals <= {0, 1} and (state > max(self.goals) or self.goals == {1} and state == 0 and at > self.last_s):
            return INFINITE
        return self.low.get((at, state), self.left[at])

    def edits(self, at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """(letter, cost, row, state) of what may come next, in ASCII order."""
        if at < self.n:
            yield "D", DELETE, at + 1, state
        if at < self.n or self.tail:
            yield "I", INSERT, at, NEXT[state][1]
        if at < self.n and self.rows[at][1] not in (BLANK, DUPLICATE):
            more = TRUNCATED if self.rows[at][1] == CUT_SHORT else 0
            if kept := AFTER.get((state, self.rows[at][0])):
                yield "K", more, at + 1, kept
            yield "R", REROLE + more, at + 1, NEXT[state][1]

    def _found(self, at: int, state: int, budget: int, path: list[str]) -> bool:
        """Whether a goal is reached at ``budget`` or less; ``path`` then has the letters."""
        self.visits += 1
        if at == self.n and state in self.goals:
            return True
        rest = INFINITE
        for letter, cost, then, into in self.edits(at, state):
            low = cost + self.least(then, into)
            if low <= budget:
                path.append(letter)
                if self._found(then, into, budget - cost, path):
                    return True
                path.pop()
                low = cost + self.least(then, into)
            rest = min(rest, low)
        self.low[at, state] = max(rest, self.least(at, state))
        return False

    def best(self, state: int) -> tuple[int, str] | None:
        """(cost, letters) from ``state``; None where no goal can be reached."""
        while (bound := self.least(0, state)) < INFINITE:
            path: list[str] = []
            if self._found(0, state, bound, path):
                return bound, "".join(path)
        return None


def chained(segments: list[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """Cost and letters of the best chain of segments, each given as (state before, state after, cost, letters).

    Of two chains to one state the cheaper is kept, then the one with lesser letters; as those of earlier
    rows decide first, it is enough to compare the places of the two earlier chains.
    """
    chains: dict[int, tuple[int, int, list[str]]] = {0: (0, 0, [])}  # by state: cost, place among the chains, pieces
    for pieces in segments:
        best: dict[int, tuple[int, int, str, int]] = {}
        for before, after, cost, letters in pieces:
            if before in chains:
                mine = (chains[before][0] + cost, chains[before][1], letters, before)
                best[after] = min(best.get(after, mine), mine)
        order = {s: k for k, s in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
        chains = {s: (cost, order[s], [*chains[before][2], letters]) for s, (cost, _, letters, before) in best.items()}
    cost, _, pieces = min(chains.values())
    return cost, "".join(pieces)


# ---- tasks ------------------------------------------------------------------------------------------


def _rows_of(codes: str) -> list[tuple[str, int]]:
    """Codes are letters: initial (s, u, a, other) and fault."""
    return [((ROLES + "?")[(ord(c) - 65) % 4], (ord(c) - 65) // 4) for c in codes]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, seg, last, codes): the pieces for each pair of states, and the counts of a segment."""
    for batch in batches:
        out: list[tuple] = []
        for key, seg, last, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows, pieces = _rows_of(codes), []
            for goals in [{0, 3}] if last else [{0}, {1}, {2}, {3}]:
                search = Search(rows, goals, tail=last)
                for state in range(4) if seg else [0]:
                    if found := search.best(state):
                        pieces.append({"before": state, "after": min(goals), "cost": found[0], "letters": found[1]})
            faults = [f for _, f in rows]
            illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
            out.append((key, seg, *(faults.count(f) for f in (BLANK, DUPLICATE, CUT_SHORT)), illegal, rows[0][0], rows[-1][0], pieces))
        schema = pa.schema([("key", pa.string()), *((c, pa.int64()) for c in ("seg", "blank", "duplicate", "truncated", "illegal")), ("first", pa.string()), ("final", pa.string()), ("pieces", pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())])))])
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(schema.types)], schema=schema)


_SEARCHED = "key string, seg long, blank long, duplicate long, truncated long, illegal long, first string, final string, pieces array<struct<before int, after int, cost long, letters string>>"


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments sorted by key and number: one row a conversation."""
    now, sums, final, segments = None, [0] * 4, "", []

    def row() -> tuple:
        cost, audit = chained(segments)
        return (now, *sums, cost, audit)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string() if k in (0, 6) else pa.int64()) for k in range(7)], ["key", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    for batch in batches:
        out = []
        for key, _, *counts, first, ending, pieces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                if segments:
                    out.append(row())
                now, sums, final, segments = key, [0] * 4, None, []
            sums = [a + b for a, b in zip(sums, counts, strict=True)]
            sums[3] += final is not None and final + first not in LEGAL
            final = ending
            segments.append([(p["before"], p["after"], p["cost"], p["letters"]) for p in pieces])
        yield batch_of(out)
    if segments:
        yield batch_of([row()])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[str, str]], bool]]:
    """Of rows sorted by key and row, the letters of the edits first (row -1): (key, repaired rows, ended), bit by bit."""
    key, letters, at, state = None, "", 0, 0

    def inserted() -> list[tuple[str, str]]:
        nonlocal at, state
        out = []
        while at < len(letters) and letters[at] == "I":
            role, state = NEXT[state]
            out.append((role, ""))
            at += 1
        return out

    for batch in batches:
        for new, row, role, text, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row < 0:
                if key is not None:
                    yield key, [], True
                key, letters, at, state = new, audit, 0, 0
                yield key, inserted(), False
                continue
            edit, at = letters[at], at + 1
            if edit == "R":
                role, state = NEXT[state]
            elif edit == "K":
                state = AFTER[state, role[:1]]
            # what is inserted behind a row goes out with it, so the last row brings the tail
            yield key, ([] if edit == "D" else [(role, text)]) + inserted(), False
    if key is not None:
        yield key, [], True


def _row_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size, pos = [], 0, 0

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if k == 1 else pa.string()) for k in range(4)], ["key", "pos", "role", "text"])

    for key, rows, ended in _repaired(batches):
        for role, text in rows:
            out.append((key, pos, role, text))
            size, pos = size + len(text), pos + 1
        pos = 0 if ended else pos
        if len(out) >= 2000 or size > 1 << 22:
            yield flushed()
            out, size = [], 0
    yield flushed()


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, digest, any_row = [], hashlib.sha256(), False
    for key, rows, ended in _repaired(batches):
        for role, text in rows:
            digest.update(f"{chr(10) if any_row else ''}{role}:{text}".encode())
            any_row = True
        if ended:
            out.append((key, digest.hexdigest()))
            digest, any_row = hashlib.sha256(), False
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(2)], ["key", "repaired_sha256"])


# ---- jobs -------------------------------------------------------------------------------------------


def _key() -> Column:
    """A text for each conv_id, another one for null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after damage by crc32(``conv_id:turn``) modulo 20 (nulls: one space).

    0 drops a row, 1 empties its text, 2 takes its ``[.!?]``, 3 repeats it, 4 makes it a user's.
    """
    space = F.lit(" ")
    hit = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), hit.alias("_hit")).where("_hit <> 0")
    text = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_hit") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("_hit") == 3, 2).otherwise(1))).alias("_n")).drop("_n")


def _ordered(rows: DataFrame) -> DataFrame:
    """key, turn, role, text and row, which grows in the order of a conversation; in range partitions, which may cut one."""
    rows = rows.select(_key().alias("key"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return ordered(rows, ["key"], ["turn", "role", "text"], "row")


def _codes(sorted_rows: DataFrame) -> DataFrame:
    """key, i (the place in the conversation) and code of each row: initial and first fault; a text's first row is found by partial sums, no row meets its copies."""
    first = sorted_rows.groupBy("key", "role", F.sha2("text", 256)).agg(F.min("row").alias("row")).select("key", "row", F.lit(True).alias("_first"))
    facts = sorted_rows.select("key", "row", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(f"[^{_SPACE}]")).alias("blank"), (~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")).alias("cut"))
    rows = scan(facts, ["key"], {"i": ("number", None)}, "row").join(first, ["key", "row"], "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("_first").isNull(), DUPLICATE).when(F.col("cut"), CUT_SHORT).otherwise(FINE)
    place = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    return rows.select("key", "i", F.char(F.lit(65) + place + 4 * fault).alias("code"))


def _plans(sorted_rows: DataFrame) -> DataFrame:
    """key, the counts of faults, cost and audit of each conversation that has rows."""
    seg = F.floor(F.col("i") / SEGMENT).alias("seg")
    coded = _codes(sorted_rows).groupBy("key", seg).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "code"))), lambda x: x["code"]), "").alias("codes"))  # SEGMENT rows at most
    turns = sorted_rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    both = coded.join(turns, "key").select("key", "seg", (F.col("seg") == F.floor((F.col("n") - 1) / SEGMENT)).alias("last"), "codes")
    # codes are few bytes and much work: dealt out by count, not by size
    found = both.repartition(4 * partitions_for(sorted_rows), "key", "seg").mapInArrow(_searched, _SEARCHED)
    plans = found.repartition("key").sortWithinPartitions("key", "seg").mapInArrow(_chains, "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    return plans.join(turns.select("key", "gaps"), "key")


def _stream(sorted_rows: DataFrame, plans: DataFrame) -> DataFrame:
    edits = plans.select("key", F.lit(-1).cast("long").alias("row"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    return edits.unionByName(sorted_rows.select("key", "row", "role", "text", F.lit("").alias("audit"))).repartition("key").sortWithinPartitions("key", "row")


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), role and text after the cheapest edits; conversations of which nothing is left have no row."""
    small_batches(conversations.sparkSession)
    sorted_rows = _ordered(conversations)
    rows = _stream(sorted_rows, _plans(sorted_rows)).mapInArrow(_row_batches, "key string, pos long, role string, text string")
    ids = conversations.groupBy(_key().alias("key")).agg(F.first("conv_id").alias("conv_id"))
    return rows.join(ids, "key").select("conv_id", "pos", "role", "text")


def audited(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row for each conv_id of ``conversations``: COUNTS, audit and the digest of the repair of ``rows`` (its own rows if not given).

    A conversation of which ``rows`` has none gets zeros, no edits and the digest of the empty text.
    """
    small_batches(conversations.sparkSession)
    sorted_rows = _ordered(conversations if rows is None else rows)
    plans = _plans(sorted_rows)
    digests = _stream(sorted_rows, plans).mapInArrow(_digest_batches, "key string, repaired_sha256 string")
    ids = conversations.groupBy(_key().alias("key")).agg(F.first("conv_id").alias("conv_id"))
    out = ids.join(plans, "key", "left").join(digests, "key", "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
