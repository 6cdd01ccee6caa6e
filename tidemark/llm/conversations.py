"""Conversation structure repair by survivor-coalescence Viterbi.

A repaired conversation is an optional system turn and then user and assistant turns in pairs, or nothing. Rows of a
conversation are read in order; after each, the decoder holds the cheapest edit sequence into every state (nothing yet,
after system, after user, after assistant). Sequences are paths of a backpointer tree whose nodes count their references;
paths that no survivor needs are freed, and once all survivors share an ancestor the edits up to it are emitted and
forgotten. Survivors are held in the order of their complete sequences: two distinct ones consumed the same rows, so neither
is a prefix of the other, and candidates that tie in cost compare as (order of the survivor, new letters), which is the
comparison of the whole unresolved suffixes. States that can only lose are dropped, so that survivors do coalesce.

Two streams per conversation: repair_plans() reads faults and roles without texts and gives one row per conversation with
its edit letters; repaired_turns() reads the letters ahead of the rows and gives the repaired turns. Both hold one
conversation's unresolved edits, never its rows. The order of a conversation is that of its turns, and its digest is one
hash over all of it, so a conversation is one task's stream however long it is; faults, which need other rows, are found by
aggregations that split hot keys before.

Defined results: a null role or text is one space; rows of one turn are ordered by role, then by the text's SHA-256;
repeated rows stand side by side, all but the first are duplicates; null conversation identifiers are one conversation; a
role that begins with none of s, u, a can be rerolled or deleted; an empty table gives an empty table; other columns are
not read and may bear any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACES, partitions, removed, table, written

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: State after a turn with this initial, by the state before it; a system turn only opens a conversation.
AFTER = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = {NOTHING: "u", SYSTEM: "u", ASSISTANT: "u", USER: "a"}
NAMES = {"u": "user", "a": "assistant"}
#: Turns to insert at the end of a conversation.
MISSING = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
SOUND, TRUNCATED, DUPLICATE, BLANK = range(4)


@dataclass(frozen=True)
class Costs:
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


class Decoder:
    """Feeds on (initial, fault) and gives edit letters: D delete, I insert, K keep, R rerole."""

    def __init__(self, costs: Costs):
        self.costs = costs
        self.moves: dict[tuple, list] = {}
        self.steps: dict[tuple, tuple] = {}
        self.begin()

    def begin(self) -> None:
        self.parent, self.letters, self.references, self.children = [-1], [""], [1], [0]
        self.free: list[int] = []
        self.root, self.base = 0, 0
        self.survivors: tuple = ((NOTHING, 0),)  # (state, cost above base), in the order of their sequences
        self.nodes = [0]
        self.emitted: list[str] = []

    def _moves(self, state: int, initial: str, fault: int) -> list[tuple[int, int, str]]:
        """(state after, cost, letters) of a row. Insertions before a deletion come after it at the same cost, in a lesser sequence."""
        costs, out = self.costs, [(state, self.costs.delete, "D")]
        if fault in (BLANK, DUPLICATE):
            return out
        extra = costs.truncated if fault == TRUNCATED else 0
        for inserted in range(2):
            if initial in AFTER and state in AFTER[initial]:
                out.append((AFTER[initial][state], inserted * costs.insert + extra, "I" * inserted + "K"))
            role = NEXT[state]
            out.append((AFTER[role][state], inserted * costs.insert + costs.rerole + extra, "I" * inserted + "R"))
            state = AFTER[role][state]
        return out

    def _step(self, survivors: tuple, initial: str, fault: int) -> tuple:
        """Survivors after a row, who each comes from, their letters, and the rise of the base cost."""
        best: dict[int, tuple] = {}
        for place, (state, cost) in enumerate(survivors):
            for after, more, letters in self._moves(state, initial, fault):
                new = (cost + more, place, letters)
                if after not in best or new < best[after]:
                    best[after] = new
        costs = self.costs
        # What a state can do, these can do at so much more: dearer states than that can only lose.
        bounds = [(ASSISTANT, SYSTEM, 0), (ASSISTANT, NOTHING, costs.delete), (ASSISTANT, USER, costs.insert), (USER, ASSISTANT, costs.insert)]
        lost = {worse for better, worse, more in bounds if better in best and worse in best and best[worse][0] > best[better][0] + more}
        kept = sorted(((place, letters, state, cost) for state, (cost, place, letters) in best.items() if state not in lost))
        low = min(cost for *_, cost in kept)
        return tuple((state, cost - low) for *_, state, cost in kept), [place for place, *_ in kept], [letters for _, letters, *_ in kept], low

    def row(self, initial: str, fault: int) -> None:
        key = (self.survivors, initial if initial in AFTER else "", fault)
        step = self.steps.get(key)
        if step is None:
            step = self.steps[key] = self._step(*key)
        self.survivors, places, letters, rise = step
        self.base += rise
        old, new = self.nodes, []
        parent, refs, kids, free = self.parent, self.references, self.children, self.free
        for place, text in zip(places, letters):
            above = old[place]
            if free:
                node = free.pop()
                parent[node], self.letters[node], refs[node], kids[node] = above, text, 1, 0
            else:
                node = len(parent)
                parent.append(above)
                self.letters.append(text)
                refs.append(1)
                kids.append(0)
            refs[above] += 1
            kids[above] ^= node
            new.append(node)
        for node in old:  # no longer a survivor: drop its own reference, and free what nobody refers to
            refs[node] -= 1
            while refs[node] == 0 and node != self.root:
                above = parent[node]
                kids[above] ^= node
                refs[above] -= 1
                free.append(node)
                node = above
        self.nodes = new
        root = self.root
        while refs[root] == 1 and root not in new:  # one child: all survivors come through it
            child = kids[root]
            self.emitted.append(self.letters[child])
            free.append(root)
            root = child
        self.root = root

    def unresolved(self) -> int:
        return len(self.parent) - len(self.free)

    def end(self) -> tuple[int, str]:
        """Least cost and the least letters of that cost; ready for the next conversation."""
        insert = self.costs.insert
        cost, place = min((cost + insert * MISSING[state], place) for place, (state, cost) in enumerate(self.survivors))
        node, path = self.nodes[place], ["I" * MISSING[self.survivors[place][0]]]
        while node != self.root:
            path.append(self.letters[node])
            node = self.parent[node]
        found = self.base + cost, "".join(self.emitted) + "".join(reversed(path))
        self.begin()
        return found


def _tail(text: Column) -> Column:
    """The last character that is no white space; empty if there is none."""
    return F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)


def _rows(rows: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None) -> DataFrame:
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dropped = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
    return rows.select(F.col(conv).alias("__conv"), F.col(turn).cast("long").alias("__turn"), one_space(role).alias("__role"), one_space(text).alias("__text"), dropped.alias("__gone")).withColumn("__sha", F.sha2("__text", 256))


def _plans(batches: Iterator[pa.RecordBatch], costs: Costs, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    decoder, conv, out = Decoder(costs), None, []
    counts, illegal, turns, least, most, last, before, open_ = [0, 0, 0, 0], 0, 0, None, None, None, None, False

    def close() -> None:
        cost, audit = decoder.end()
        out.append((conv, most - least + 1 - turns if turns else 0, counts[BLANK], counts[DUPLICATE], counts[TRUNCATED], illegal, cost, audit))

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*out), schema)], schema=schema)
        out.clear()
        return made

    for batch in batches:
        for this, turn, initial, fault, again, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if not open_ or this != conv:
                if open_:
                    close()
                open_, conv, counts, illegal, turns, least, most, last, before = True, this, [0, 0, 0, 0], 0, 0, None, None, None, None
            if not copies:  # a row that was dropped: only its conversation counts
                continue
            if turn is not None and turn != last:
                turns, least, most, last = turns + 1, turn if least is None else least, turn, turn
            later = BLANK if fault == BLANK else DUPLICATE
            for copy in range(copies):
                now = later if again or copy else fault
                counts[now] += 1
                illegal += before is not None and before + initial not in ("su", "ua", "au")
                before = initial
                decoder.row(initial, now)
        if len(out) >= 1000 or sum(len(x[-1]) for x in out) > 4 << 20:
            yield flush()
    if open_:
        close()
    if out:
        yield flush()


def repair_plans(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None, costs: Costs = Costs()) -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit (edit letters in order).

    gone: a boolean column; rows where it is true are left out, but their conversations are not.
    """
    n, tail = partitions(rows.sparkSession), _tail(F.col("__text"))
    fault = F.when(tail == "", BLANK).when(tail.isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    keys = ["__conv", "__role", "__sha"]
    slim = _rows(rows, conv, turn, role, text, gone).select(*keys, "__turn", fault.alias("__fault"), "__gone")
    # Identical rows become one with their number; the first turn of a role and text decides who is the duplicate.
    runs = written(slim.groupBy(*keys, "__turn", "__fault", "__gone").agg(F.count("*").alias("__n")), "runs")
    place = F.struct(F.col("__turn").isNotNull().alias("k"), F.col("__turn").alias("t"))
    firsts = runs.where(~F.col("__gone")).groupBy(*(F.col(k).alias(k[1:]) for k in keys)).agg(F.min(place).alias("first"))
    same = F.col("__conv").eqNullSafe(F.col("_conv")) & (F.col("__role") == F.col("_role")) & (F.col("__sha") == F.col("_sha")) & ~F.col("__gone")
    flagged = runs.join(firsts, same, "left")
    ordered = flagged.repartition(n, "__conv").sortWithinPartitions("__conv", "__turn", "__role", "__sha").select(
        "__conv", "__turn", F.substring("__role", 1, 1).alias("__initial"), "__fault", F.coalesce(~place.eqNullSafe(F.col("first")), F.lit(False)).alias("__again"), F.when(F.col("__gone"), 0).otherwise(F.col("__n")).alias("__n")
    )
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    arrow = pa.schema([pa.field("conv", {"bigint": pa.int64(), "int": pa.int32()}.get(dict(slim.dtypes)["__conv"], pa.string())), *(pa.field(x, pa.int64()) for x in numbers), pa.field("audit", pa.string())])
    spark_type = {pa.int64(): "bigint", pa.int32(): "int"}.get(arrow.field("conv").type, "string")
    ordered = ordered.withColumn("__conv", F.col("__conv").cast(spark_type))
    plans = ordered.mapInArrow(lambda batches: _plans(batches, costs, arrow), f"conv {spark_type}, " + ", ".join(f"{x} bigint" for x in numbers) + ", audit string")
    plans = written(plans, "plans")
    removed(runs)
    return plans


def _turns(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows behind the letters of their conversation become its repaired turns."""
    conv, letters, at, state, step = None, "", 0, NOTHING, 0
    out: list[tuple] = []

    def put(edit: str, turn: int | None, role: str, text: str) -> None:
        nonlocal state, step
        state, step = AFTER[role[0]][state], step + 1
        out.append((conv, step, edit, turn, role, text))

    def inserted() -> None:
        nonlocal at
        while at < len(letters) and letters[at] == "I":
            put("I", None, NAMES[NEXT[state]], "")
            at += 1

    for batch in batches:
        for this, audit, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if audit is not None:
                inserted()
                conv, letters, at, state, step = this, audit, 0, NOTHING, 0
                continue
            inserted()
            letter, at = letters[at], at + 1
            if letter != "D":
                put(letter, turn, role if letter == "K" else NAMES[NEXT[state]], text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*out), schema)], schema=schema)
            out = []
    inserted()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*out), schema)], schema=schema)


def repaired_turns(rows: DataFrame, plans: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """The repaired turns: conv, step (from 1), edit (I, K or R), turn (null if inserted), role, text; those of a conversation are in order within one partition."""
    spark_type = dict(plans.dtypes)["conv"]
    left = _rows(rows, conv, turn, role, text, gone).where(~F.col("__gone")).select(F.col("__conv").cast(spark_type).alias("__conv"), F.lit(None).cast("string").alias("__audit"), "__turn", "__role", "__text", "__sha")
    heads = plans.select(F.col("conv").alias("__conv"), F.col("audit").alias("__audit"), *(F.lit(None).cast(t).alias(c) for c, t in left.dtypes[2:]))
    stream = heads.unionByName(left).repartition(partitions(rows.sparkSession), "__conv").sortWithinPartitions("__conv", F.col("__audit").isNull(), "__turn", "__role", "__sha").drop("__sha")
    kind = {"bigint": pa.int64(), "int": pa.int32()}.get(spark_type, pa.string())
    arrow = pa.schema([("conv", kind), ("step", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    return stream.mapInArrow(lambda batches: _turns(batches, arrow), f"conv {spark_type}, step bigint, edit string, turn bigint, role string, text string")


def turn_digests(turns: DataFrame) -> DataFrame:
    """conv, sha256 of its `role:text` lines joined by newlines. turns as repaired_turns() gives them: in order, not dealt out again."""
    kind = dict(turns.dtypes)["conv"]
    arrow = pa.schema([("conv", {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha = None, None
        for batch in batches:
            done: list[tuple] = []
            for this, step, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if step == 1:
                    if sha:
                        done.append((conv, sha.hexdigest()))
                    conv, sha = this, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], arrow[0].type), pa.array([x for _, x in done], arrow[1].type)], schema=arrow)
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([conv], arrow[0].type), pa.array([sha.hexdigest()], arrow[1].type)], schema=arrow)

    return turns.select("conv", "step", "role", "text").mapInArrow(run, f"conv {kind}, sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """rows with role and text damaged by the CRC-32 of `conv_id:turn`, some twice, and column gone where a row is dropped."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(one_space("conv_id"), F.lit(":"), one_space("turn")).cast("binary")) % 20
    slim = rows.select("conv_id", "turn", one_space("role").alias("role"), one_space("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return slim.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    plans = repair_plans(rows, gone="gone")
    hashes = turn_digests(repaired_turns(rows, plans, gone="gone")).withColumnRenamed("conv", "__conv")
    empty = hashlib.sha256().hexdigest()
    joined = plans.join(hashes, F.col("conv").eqNullSafe(F.col("__conv")), "left")
    return joined.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256"))


#: crc32 bit by bit; then a dynamic programme over rows that keeps the cheapest, then least, letters of every state.
OP11_SQL = """
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
c AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(s) + 1), lambda i: [CAST(ascii(substr(s, i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 20 AS code FROM k),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN code = 1 THEN '' WHEN code = 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
    FROM c, (VALUES (1), (2)) v(copy) WHERE code <> 0 AND (copy = 1 OR code = 3)),
f AS (SELECT *, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), seen) AS i FROM f),
r AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS ini, CASE WHEN tail = '' THEN 3 WHEN seen > 1 THEN 2 WHEN tail IN ('.', '!', '?') THEN 0 ELSE 1 END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
convs AS (SELECT DISTINCT conv_id FROM conversations),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (before || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM r GROUP BY conv_id),
ins(state, k, after, roles) AS (VALUES ('0', 0, '0', ''), ('s', 0, 's', ''), ('u', 0, 'u', ''), ('a', 0, 'a', ''), ('0', 1, 'u', 'u'), ('s', 1, 'u', 'u'), ('u', 1, 'a', 'a'), ('a', 1, 'u', 'u'),
    ('0', 2, 'a', 'ua'), ('s', 2, 'a', 'ua'), ('u', 2, 'u', 'au'), ('a', 2, 'a', 'ua')),
put(state, ini) AS (VALUES ('0', 's'), ('0', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a')),
filler(roles, lines) AS (VALUES ('', ''), ('u', chr(10) || 'user:'), ('a', chr(10) || 'assistant:'), ('ua', chr(10) || 'user:' || chr(10) || 'assistant:'), ('au', chr(10) || 'assistant:' || chr(10) || 'user:')),
moves AS (SELECT ins.state, ins.k, ins.after AS mid, filler.lines FROM ins JOIN filler USING (roles)),
dp AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS i, '0' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS lines FROM convs
    UNION ALL
    SELECT conv_id, i, state, cost, audit, lines FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS best FROM (
            SELECT r.conv_id, r.i, dp.state, dp.cost + 3 AS cost, dp.audit || 'D' AS audit, dp.lines FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1
            UNION ALL
            SELECT r.conv_id, r.i, r.ini, dp.cost + 2 * m.k + (r.fault = 1)::INT, dp.audit || repeat('I', m.k) || 'K', dp.lines || m.lines || chr(10) || r.role || ':' || r.text
            FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1 JOIN moves m ON m.state = dp.state JOIN put ON put.state = m.mid AND put.ini = r.ini WHERE r.fault < 2
            UNION ALL
            SELECT r.conv_id, r.i, put.ini, dp.cost + 2 * m.k + 2 + (r.fault = 1)::INT, dp.audit || repeat('I', m.k) || 'R', dp.lines || m.lines || chr(10) || CASE put.ini WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text
            FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1 JOIN moves m ON m.state = dp.state JOIN put ON put.state = m.mid AND put.ini IN ('u', 'a') WHERE r.fault < 2)
    ) WHERE best = 1),
ends AS (SELECT dp.conv_id, dp.cost + 2 * m.k AS cost, dp.audit || repeat('I', m.k) AS audit, dp.lines || m.lines AS lines,
    row_number() OVER (PARTITION BY dp.conv_id ORDER BY dp.cost + 2 * m.k, dp.audit || repeat('I', m.k)) AS best
    FROM dp LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM dp.conv_id JOIN moves m ON m.state = dp.state WHERE dp.i = coalesce(sums.n, 0) AND m.mid IN ('0', 'a'))
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    e.cost, e.audit, sha256(substr(e.lines, 2)) AS repaired_sha256
FROM ends e LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM e.conv_id WHERE e.best = 1
"""
