"""Conversation structure repair: the cheapest edits that give every conversation the form (s?(ua)+)?.

Roles count by their first letter: an optional system turn, then user and assistant in turn.
Edits are Keep (0), Rerole to user or assistant (3), Delete (4; a must for blank and duplicate
turns) and Insert an empty user or assistant turn anywhere (3); a truncated turn that stays adds
3. Of equally cheap edits those whose initials, in order, are ASCII-least are taken.

Turns are numbered in ranges of (conversation, turn, ...) and cut into groups of GROUP. Groups
are dealt by hash; in every batch of groups one recursive DuckDB query advances one turn for all
of them at each recursion and keeps, per grammar state at the group's start and now, the least
cost and its edits. (At equal cost no edits are the beginning of others for the same turns: the
rest would be paid insertions. So keeping the least per state keeps the least of all.) A group
is then a table from state to state, and GROUP neighbours of one conversation are folded by the
same query, level by level, until one is left; so a conversation that holds a third of all turns
is shared by many tasks. The edits are played on the turns in one sorted pass, in which a
conversation streams through a task and is never held.

The grammar's states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.

Nulls: role and text that are null are one space; null turns come first; turns without a
conversation id are one conversation. Turns of one number are ordered by role, then the md5 of
the text, and repeated rows stand beside each other (all but the first are duplicates). A
conversation without turns doesn't exist; an empty table gives an empty result. Very long texts
are carried whole, in two shuffles. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from .common import materialize

GROUP = 64
#: Turns or groups that one DuckDB query takes at a time.
BATCH = 32_768
#: Turns that are held as Python rows at a time.
SLICE = 1024
#: Fixed values of the contract.
SPACES = " \t\n\x0b\x0c\r"
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
STATES = range(4)
ROLES = ("system", "user", "assistant")
#: (state, role's class) -> state; classes 0 to 2 are ROLES, 3 all others.
MOVES = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
LEGAL = {(0, 1), (1, 2), (2, 1)}


def insertions(state: int) -> Iterator[tuple[int, int, str]]:
    """(state, cost, edits) after no, one or two insertions; more would only come back to one of these states."""
    yield state, 0, ""
    one = 3 if state == 2 else 2
    yield one, COSTS["I"], "I"
    yield (2 if one == 3 else 3), 2 * COSTS["I"], "II"


def _steps() -> list[tuple[int, int, int, int, str]]:
    """(kind, state before, state after, cost, edits): a turn's ways; kind = 4 * class + 2 * must be deleted + truncated."""
    rows = []
    for kind in range(16):
        role, must, cut = kind // 4, kind // 2 % 2, kind % 2
        for start in STATES:
            for state, paid, edits in insertions(start):
                ways = [("D", state, 0)]
                if not must:
                    ways += [("K", MOVES[state, role], cut)] if (state, role) in MOVES else []
                    ways += [("R", 3 if state == 2 else 2, cut)]
                rows += [(kind, start, after, paid + COSTS[edit] + cut_ * TRUNCATED, edits + edit) for edit, after, cut_ in ways]
    return rows


_EDGE = [("p", "int"), ("q", "int"), ("cost", "long"), ("audit", "string")]
_EDGES = f"array<struct<{','.join(f'{c}:{t}' for c, t in _EDGE)}>>"
_ARROW_EDGES = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

#: From turns(g, k, starts) and pieces(g, k, p, q, cost, audit): the k-th turn of group g leads from state p to q so.
_ADVANCE = """
WITH RECURSIVE size AS (SELECT g, max(k) + 1 AS n, bool_or(starts) AS starts FROM turns GROUP BY g),
best(g, k, p, q, b) AS (
    SELECT g, 0, p, p, {'cost': CAST(0 AS BIGINT), 'audit': ''} FROM (SELECT g, unnest(CASE WHEN starts THEN [0] ELSE [0, 1, 2, 3] END) AS p FROM size)
    UNION ALL
    SELECT m.g, m.k + 1, m.p, x.q, min({'cost': m.b.cost + x.cost, 'audit': m.b.audit || x.audit}) FROM best m JOIN pieces x ON x.g = m.g AND x.k = m.k AND x.p = m.q GROUP BY m.g, m.k, m.p, x.q)
SELECT list({'p': p, 'q': q, 'cost': b.cost, 'audit': b.audit} ORDER BY p, q) AS edges FROM best JOIN size USING (g) WHERE k = n GROUP BY g ORDER BY g"""
_OF_TURNS = "CREATE VIEW pieces AS SELECT g, k, p, q, cost, audit FROM turns JOIN steps USING (kind)"
_OF_GROUPS = "CREATE VIEW pieces AS SELECT g, k, e.p, e.q, e.cost, e.audit FROM (SELECT g, k, unnest(edges) AS e FROM turns)"


def _batches_of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The sorted rows as tables of whole groups, of about BATCH rows, and where groups begin in each."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.table(batch))
        if sum(t.num_rows for t in held) >= BATCH:
            table = pa.concat_tables(held)
            last = int(np.flatnonzero(table.column("begins").to_numpy(zero_copy_only=False))[-1])
            held = [table.slice(last)]
            if last:
                yield table.slice(0, last), np.flatnonzero(table.slice(0, last).column("begins").to_numpy(zero_copy_only=False))
    if held and (table := pa.concat_tables(held)).num_rows:
        yield table, np.flatnonzero(table.column("begins").to_numpy(zero_copy_only=False))


def _fold(turns: bool) -> Callable:
    """A task that turns sorted turns (or groups) into one row per group: its illegal neighbours and its table from state to state."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        con.execute("CREATE TABLE steps (kind INT, p INT, q INT, cost BIGINT, audit VARCHAR)")
        con.executemany("INSERT INTO steps VALUES (?, ?, ?, ?, ?)", _steps())
        made = False
        for table, first in _batches_of_groups(batches):
            g = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
            if turns:
                role = table.column("kind").to_numpy() // 4
                pair = np.append(-1, role[:-1] * 4 + role[1:])
                pair[first] = -1
                illegal = (pair >= 0) & ~np.isin(pair, [a * 4 + b for a, b in LEGAL])
            else:
                illegal = table.column("illegal").to_numpy()
            sums = np.bincount(g, illegal, len(first)).astype(np.int64)
            rows = table.append_column("g", pa.array(g)).append_column("starts", pc.equal(table.column("grp"), 0))
            con.register("turns", rows.filter(pc.greater_equal(rows.column("k"), 0)))
            real = np.bincount(g, table.column("k").to_numpy() >= 0, len(first)) > 0
            if not made:
                con.execute(_OF_TURNS if turns else _OF_GROUPS)
                made = True
            edges = con.sql(_ADVANCE).to_arrow_table().column("edges").cast(_ARROW_EDGES).combine_chunks()
            heads = table.select(["conv_id", "grp"]).take(pa.array(first[real]))
            yield from pa.table({"conv_id": heads.column("conv_id"), "grp": heads.column("grp"), "illegal": sums[real], "edges": edges}).combine_chunks().to_batches()

    return task


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of "conv_id:turn" modulo 20; nulls are one space there and in role and text."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), fault.alias("_hn_fault")).where("_hn_fault <> 0")
    text = F.when(F.col("_hn_fault") == 1, "").when(F.col("_hn_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_hn_fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("_hn_fault") == 3, 2).otherwise(1))).alias("_hn_copy"))
    return rows.drop("_hn_copy")


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the place: (range, at) grow along the conversation. Equal rows may spread over ranges."""
    said = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text")).withColumns({"_hn_text": F.md5("text"), "_hn_id": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("_hn_text"), F.asc("_hn_id")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_hn_id", "_hn_text")
    return materialize(rows.withColumns({"range": F.spark_partition_id().cast("long"), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "turns")


def judged(rows: DataFrame) -> DataFrame:
    """A row per turn without its text: conv_id, pos (from 0), turn, kind, blank, duplicate, truncated (the first that holds)."""
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    role = F.substring("role", 1, 1)
    small = rows.select("conv_id", "range", "at", "turn", F.coalesce(*(F.when(role == r[0], i) for i, r in enumerate(ROLES)), F.lit(3)).alias("role"), F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("said"), (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"))
    small = materialize(small, "turn-faults")
    counts = small.groupBy("conv_id", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"))
    again = small.groupBy("conv_id", "said").agg(F.min(F.struct("range", "at")).alias("first_said"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c2"), F.col("said").alias("s2"), "first_said")
    found = small.join(base, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r"))).join(again, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("said") == F.col("s2")), "left")
    repeat = F.coalesce(F.struct("range", "at") > F.col("first_said"), F.lit(False))
    found = found.select("conv_id", (F.col("base") + F.col("at")).alias("pos"), "turn", "role", "blank", (~F.col("blank") & repeat).alias("duplicate"), (~F.col("blank") & ~repeat & F.col("cut")).alias("truncated"))
    kind = 4 * F.col("role") + 2 * (F.col("blank") | F.col("duplicate")).cast("int") + F.col("truncated").cast("int")
    return materialize(found.withColumn("kind", kind.cast("int")).drop("role"), "turn-kinds")


def cheapest(turns: DataFrame) -> DataFrame:
    """conv_id, illegal, cost, audit of the judged turns."""
    fields = {f.name: f for f in turns.schema.fields}
    schema = StructType([fields["conv_id"], StructField("grp", LongType()), StructField("illegal", LongType()), *StructType.fromDDL(f"edges {_EDGES}").fields])
    last = turns.agg(F.max("pos")).first()[0] or 0
    # a group's first row repeats the turn before it, at k = -1, for the count of illegal neighbours; a group of such a row alone is none
    grp, k = F.floor(F.col("pos") / GROUP), (F.col("pos") % GROUP).cast("int")
    at = F.when(k == GROUP - 1, F.array(F.struct(grp.alias("grp"), k.alias("k")), F.struct((grp + 1).alias("grp"), F.lit(-1).alias("k")))).otherwise(F.array(F.struct(grp.alias("grp"), k.alias("k"))))
    rows = turns.select("conv_id", "pos", "kind", F.explode(at).alias("x")).select("conv_id", "x.grp", "x.k", "kind", ((F.col("x.k") == -1) | (F.col("pos") == 0)).alias("begins"))
    groups = _dealt(rows).mapInArrow(_fold(True), schema)
    last //= GROUP
    while last:
        k = (F.col("grp") % GROUP).cast("int")
        rows = groups.select("conv_id", F.floor(F.col("grp") / GROUP).alias("grp"), k.alias("k"), "illegal", "edges", (k == 0).alias("begins"))
        groups = _dealt(rows).mapInArrow(_fold(False), schema)
        last //= GROUP
    closed = lambda x: F.struct((x["cost"] + F.when(x["q"] == 1, 6).when(x["q"] == 2, 3).otherwise(0)).alias("cost"), F.concat(x["audit"], F.when(x["q"] == 1, "II").when(x["q"] == 2, "I").otherwise("")).alias("audit"))
    best = F.array_min(F.transform(F.filter("edges", lambda x: x["p"] == 0), closed))
    return groups.select("conv_id", "illegal", best.alias("best")).select("conv_id", "illegal", "best.cost", "best.audit")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id", "grp").sortWithinPartitions("conv_id", "grp", "k")


def played(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(conv_id, audit, role, text) - for each conversation its audit without a turn, then its turns - as (conv_id, at, role, text, edit) after the edits."""
    conv, audit, at, state, n = None, "", 0, 0, 0
    for conv_id, edits, role, text in chain(rows, [(None, "", None, None)]):
        while audit[at : at + 1] == "I":
            state = 3 if state == 2 else 2
            yield conv, n, ROLES[state - 1], "", "I"
            at, n = at + 1, n + 1
        if edits is not None:
            conv, audit, at, state, n = conv_id, edits, 0, 0, 0
            continue
        edit, at = audit[at], at + 1
        if edit == "D":
            continue
        state = MOVES[state, [r[0] for r in ROLES].index(role[0])] if edit == "K" else 3 if state == 2 else 2
        yield conv, n, role if edit == "K" else ROLES[state - 1], text, edit
        n += 1


def digests(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(conv_id, sha256 of its lines `role:text`) of rows (conv_id, at, role, text) in order."""
    conv, digest = None, None
    for conv_id, at, role, text in rows:
        if at == 0:
            if digest:
                yield conv, digest.hexdigest()
            conv, digest = conv_id, sha256()
        digest.update((f"{role}:{text}" if at == 0 else f"\n{role}:{text}").encode("utf-8", "surrogatepass"))
    if digest:
        yield conv, digest.hexdigest()


def _streamed(make: Callable[[Iterable[tuple]], Iterator[tuple]], schema: StructType, columns: list[str]) -> Callable:
    """A task that streams rows through a generator, SLICE rows in and out at a time."""
    arrow = to_arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE))
        out = make(row for p in parts for row in zip(*(p.column(c).to_pylist() for c in columns)))
        while rows := list(islice(out, SLICE)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return task


def _conv(df: DataFrame, ddl: str) -> StructType:
    return StructType([df.schema["conv_id"], *StructType.fromDDL(ddl).fields])


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, at (from 0), role, text, edit: the turns of all conversations after their edits, a conversation's in order in one partition."""
    heads = edits.select("conv_id", F.lit(-1).cast("long").alias("range"), F.lit(-1).cast("long").alias("at"), "audit")
    both = rows.select("conv_id", "range", "at", "role", "text").unionByName(heads, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "range", "at")
    schema = _conv(rows, "at long, role string, text string, edit string")
    return both.mapInArrow(_streamed(played, schema, ["conv_id", "audit", "role", "text"]), schema)


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a summary per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit; the repaired turns)."""
    rows = ordered(conversations)
    turns = judged(rows)
    edits = materialize(cheapest(turns), "edits")
    counts = turns.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), *(F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    summary = counts.unionByName(edits, allowMissingColumns=True).groupBy("conv_id").agg(*(F.max(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")))
    return summary, repaired(rows, edits)


def repair_digest(conversations: DataFrame, damaged: DataFrame) -> DataFrame:
    """A row per conversation of the table before damage: its summary, and the repaired turns' SHA-256 - a conversation's
    is one computation, through which its turns stream."""
    summary, turns = repair(damaged)
    schema = _conv(turns, "repaired_sha256 string")
    hashed = turns.mapInArrow(_streamed(digests, schema, ["conv_id", "at", "role", "text"]), schema)
    parts = conversations.select("conv_id").distinct().unionByName(summary, allowMissingColumns=True).unionByName(hashed, allowMissingColumns=True)
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    found = parts.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in longs), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.max("repaired_sha256").alias("repaired_sha256"))
    return found.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())))
