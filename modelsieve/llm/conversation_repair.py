"""Repair of conversations: the cheapest edits that make the turns a legal dialogue.

A legal dialogue has role initials ``(s?(ua)+)?``. A turn is kept (free), rerolled to user or assistant
(1) or deleted (2); empty user or assistant turns are inserted anywhere (5). A turn whose first fault
is blank or duplicate has to be deleted; one that ends without ``.``, ``!`` or ``?`` adds 5 where it is
not deleted. Of all cheapest edits the one with the least audit, the edits' initials in order, wins.

Depth-first branch-and-bound over nodes (turns read, state of the dialogue): an explicit stack; a lower
bound per node for the turns that follow; an incumbent of cost and audit; and a table with the cost
at which each node was entered before, which eliminates prefixes that are no better. Bounds are the
cheapest costs if audits did not matter, from one backward pass, so the first descent finds the least
cost, and what is left on the stack only has to show that no tie has a lesser audit. Branches of equal
bound are taken in the order of their letters, so a prefix that comes later at the same cost is worse.

Decisions need one compact row per turn (initial, faults, a digest), in order; the texts pass a second
time in the same order, are edited as the audit says, and are never held. A conversation of any
length therefore needs memory per turn (below 200 bytes), not per character, in the one task that
reads it: the edits of a conversation depend on all of its turns.

Defined cases: null roles and texts are one space; null turns come first; turns of equal number are
ordered by the SHA-256 of role and text; rows that repeat are duplicates. A null id is a conversation of
its own. A role without characters, or with another initial, can be rerolled or deleted only. A conversation without rows has zeros and
an empty audit. An empty table gives an empty result. Only the four columns are read, so other columns
may have any name.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from modelsieve.llm.common import text_of, written

KEEP, REROLE, DELETE, INSERT, BLANK, DUPLICATE, TRUNCATED = "K", "R", "D", "I", "b", "d", "t"
REROLED, DELETED, INSERTED, UNFINISHED = 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"

#: States of the dialogue: nothing yet, after system, after user, after assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
STEPS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after a turn of the role that is due: user, but assistant after user.
DUE = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 60


def bounds(initials: list[str], faults: list[str]) -> list[array]:
    """Per state, the least cost of the turns from each place to the end."""
    n = len(initials)
    rest = [array("q", [NEVER]) * (n + 1) for _ in DUE]
    for i in range(n, -1, -1):
        cost = []
        for state in range(len(DUE)):
            if i == n:
                cost.append(0 if state in ENDS else NEVER)
                continue
            best = DELETED + rest[state][i + 1]
            if faults[i] not in (BLANK, DUPLICATE):
                extra = UNFINISHED if faults[i] == TRUNCATED else 0
                best = min(best, extra + REROLED + rest[DUE[state]][i + 1])
                if (state, initials[i]) in STEPS:
                    best = min(best, extra + rest[STEPS[state, initials[i]]][i + 1])
            cost.append(best)
        # One insertion leads to the state that is due; from there, a second one may lead on.
        once = [min(cost[s], INSERTED + cost[DUE[s]]) for s in range(len(DUE))]
        for state in range(len(DUE)):
            rest[state][i] = min(cost[state], INSERTED + once[DUE[state]])
    return rest


def _branches(i: int, state: int, cost: int, initials: list[str], faults: list[str]) -> Iterator[tuple[str, int, int, int]]:
    """``letter, place, state, cost`` of every edit that may follow."""
    yield INSERT, i, DUE[state], cost + INSERTED
    if i == len(initials):
        return
    yield DELETE, i + 1, state, cost + DELETED
    if faults[i] in (BLANK, DUPLICATE):
        return
    extra = UNFINISHED if faults[i] == TRUNCATED else 0
    yield REROLE, i + 1, DUE[state], cost + extra + REROLED
    if (state, initials[i]) in STEPS:
        yield KEEP, i + 1, STEPS[state, initials[i]], cost + extra


def cheapest(initials: list[str], faults: list[str]) -> tuple[int, str]:
    """Least cost and, of its edits, the least audit."""
    n, rest = len(initials), bounds(initials, faults)
    entered = [array("q", [NEVER]) * (n + 1) for _ in DUE]
    best_cost, best_audit = NEVER, None
    trail: list[str] = []
    stack = [(0, "", 0, NOTHING, 0)]
    while stack:
        depth, letter, i, state, cost = stack.pop()
        if cost + rest[state][i] > best_cost or cost >= entered[state][i]:
            continue
        entered[state][i] = cost
        del trail[max(depth - 1, 0) :]
        if letter:
            trail.append(letter)
        if i == n and state in ENDS:
            if cost < best_cost or "".join(trail) < best_audit:
                best_cost, best_audit = cost, "".join(trail)
            continue  # further insertions only cost more
        branches = [(c + rest[s][j], x, j, s, c) for x, j, s, c in _branches(i, state, cost, initials, faults)]
        branches.sort(reverse=True)
        stack.extend((depth + 1, x, j, s, c) for bound, x, j, s, c in branches if bound <= best_cost)
    return best_cost, best_audit


def edits(audit: Iterable[str], turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """``edit, role, text`` of the turns that an audit leaves; ``turns``: role and text, in order."""
    state = NOTHING
    for letter in audit:
        role, text = next(turns) if letter != INSERT else ("", "")
        if letter == DELETE:
            continue
        state = STEPS[state, role[:1]] if letter == KEEP else DUE[state]
        yield letter, role if letter == KEEP else ROLE[state], text


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with known damage, by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats it, 4 makes it the user's.
    """
    name = F.concat(text_or_space("conv_id"), F.lit(":"), text_or_space("turn"))
    case = F.crc32(name) % 20
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    plain = ordered_rows(conversations).withColumn("case", case).where("case <> 0")
    return plain.withColumns(
        {
            "text": text,
            "role": F.when(case == 4, "user").otherwise(F.col("role")),
            "copy": F.explode(F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
        }
    ).drop("case")


def text_or_space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def ordered_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with ``tie`` and ``copy``, which order turns of one number."""
    rows = conversations.select("conv_id", "turn", text_or_space("role").alias("role"), text_or_space("text").alias("text"))
    return rows.withColumn("tie", content()).withColumn("copy", F.lit(0))


def content() -> Column:
    """A digest of role and text."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def _in_order(rows: DataFrame) -> DataFrame:
    """Conversations whole, one after the other, in turns' order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "tie", "copy")


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _groups(records: Iterable[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Consecutive records of one conversation, without holding them; each group is read to its end."""
    records = iter(records)
    waiting = next(records, None)

    def group(key):
        nonlocal waiting
        while waiting is not None and waiting[0] == key:
            record, waiting = waiting, next(records, None)
            yield record

    while waiting is not None:
        members = group(waiting[0])
        yield waiting[0], members
        for _ in members:
            pass


def _batches(rows: Iterable[tuple], schema: pa.Schema, most_rows: int = 2000, most_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[-1]) if isinstance(row[-1], str) else 0
        if len(held) >= most_rows or chars >= most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _decide(turns: Iterable[tuple]) -> tuple:
    """Counts, cost and audit of one conversation from its compact rows."""
    initials, faults, seen, numbers, pairs = [], [], set(), [], 0
    n_turns, first, last = 0, None, None
    for turn, initial, blank, unfinished, digest in turns:
        if turn is not None and turn != last:
            n_turns, first, last = n_turns + 1, turn if first is None else first, turn
        faults.append(BLANK if blank else DUPLICATE if digest in seen else TRUNCATED if unfinished else "")
        seen.add(digest)
        if initials and initials[-1] + initial not in ("su", "ua", "au"):
            pairs += 1
        initials.append(initial if initial in ("s", "u", "a") else "")
    gaps = last - first + 1 - n_turns if n_turns else 0
    return (gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), pairs, *cheapest(initials, faults))


def _with_id(rows: DataFrame, more: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *T.StructType.fromDDL(more).fields])


def decisions(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows``: gaps, counts of faults and illegal pairs, cost and audit."""
    stripped = F.rtrim("text", F.lit(BLANKS))
    compact = rows.select(
        "conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), (stripped == "").alias("blank"),
        (~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("unfinished"), content().alias("digest"),
        F.lit(0).alias("kind"), "tie", "copy",
    )
    schema = _with_id(rows, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    arrow = to_arrow_schema(schema)

    def decide(batches):
        found = ((key, *_decide(r[1:6] for r in members)) for key, members in _groups(_records(batches)))
        yield from _batches(found, arrow)

    return _in_order(compact).mapInArrow(decide, schema)


def repaired_turns(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """The turns of every repaired conversation: ``conv_id, place, edit, role, text``, in order within a task."""
    none = F.lit(None)
    audits = decided.select(
        "conv_id", F.lit(0).alias("kind"), none.cast("string").alias("role"), F.col("audit").alias("text"),
        none.cast(rows.schema["turn"].dataType).alias("turn"), none.cast("binary").alias("tie"), none.cast("int").alias("copy"),
    )
    turns = rows.select("conv_id", F.lit(1).alias("kind"), "role", "text", "turn", "tie", "copy")
    schema = _with_id(rows, "place long, edit string, role string, text string")
    arrow = to_arrow_schema(schema)

    def repair(batches):
        def found():
            for key, members in _groups(_records(batches)):
                audit = next(members)[3]
                for place, turn in enumerate(edits(audit, ((r[2], r[3]) for r in members))):
                    yield (key, place, *turn)

        yield from _batches(found(), arrow)

    return _in_order(audits.unionByName(turns)).mapInArrow(repair, schema)


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` over ``role:text``, newline-joined; ``turns`` as from ``repaired_turns``."""
    schema = _with_id(turns, "repaired_sha256 string")
    arrow = to_arrow_schema(schema)

    def digest(batches):
        def found():
            for key, members in _groups(_records(batches)):
                total = hashlib.sha256()
                for _, place, _, role, text in members:
                    total.update(f"{chr(10) if place else ''}{role}:{text}".encode())
                yield key, total.hexdigest()

        yield from _batches(found(), arrow)

    return turns.mapInArrow(digest, schema)


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conversation: what was wrong in ``rows``, the edits, and a digest of the repaired turns."""
    decided = written(decisions(rows), "conversation-decisions")
    repaired = digests(repaired_turns(rows, decided)).withColumnRenamed("conv_id", "r_id")
    found = decided.join(repaired, F.col("conv_id").eqNullSafe(F.col("r_id")), "left").withColumnRenamed("conv_id", "d_id")
    every = conversations.select("conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("d_id")), "left").select(
        "conv_id",
        *(F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
