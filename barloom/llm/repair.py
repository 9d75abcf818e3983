"""Conversation structure repair: cheapest edits to role order, by Viterbi with survivor coalescence.

A conversation is sound when the initials of its roles give `(s?(ua)+)?`. Edits are Keep (0),
Rerole to user or assistant (3), Delete (4, the only one for blank and duplicate rows) and
Insert of an empty user or assistant turn (3); truncated rows that stay cost 3 more.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What the output ends with: nothing yet, the system turn, a user turn, an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: A survivor of the first state can't be on the cheapest path, not even tied, when it costs more
#: than one of the second state plus this: what the first can do, the second can for so much more.
BOUNDS = (
    (NOTHING, ASSISTANT, DELETE), (NOTHING, USER, DELETE + INSERT), (SYSTEM, ASSISTANT, 0),
    (SYSTEM, USER, INSERT), (USER, ASSISTANT, INSERT), (ASSISTANT, USER, INSERT),
)
CHARACTER = r"[^\x20\x09-\x0D]"
BIGGEST = (1 << 63) - 1


def _next(state: int) -> int:
    """The state after a user or assistant turn, whichever fits."""
    return ASSISTANT if state == USER else USER


def moves(initial: str, must_go: bool, truncated: bool) -> tuple:
    """(from, to, cost, edits) of one row and the inserts before it, the best for each pair.

    Inserts before a Delete are left out: behind it they cost the same and compare less.
    """
    best: dict = {}
    for start in range(4):
        best[start, start] = (DELETE, "D")
        state, cost, inserts = start, TRUNCATED * truncated, ""
        for _ in range(0 if must_go else 3):
            to = {"u": USER, "a": ASSISTANT}.get(initial)
            found = [(_next(state), cost + REROLE, inserts + "R")]
            if to == _next(state):
                found.append((to, cost, inserts + "K"))
            if initial == "s" and state == NOTHING:
                found.append((SYSTEM, cost, inserts + "K"))
            for end, total, edits in found:
                best[start, end] = min(best.get((start, end), (total, edits)), (total, edits))
            state, cost, inserts = _next(state), cost + INSERT, inserts + "I"
    return tuple((a, b, cost, edits) for (a, b), (cost, edits) in best.items())


#: Inserts that complete the output from each state.
CLOSING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


class _Node:
    """A step of a survivor: its edits and row, the step before, and who still refers to it."""

    __slots__ = ("parent", "children", "held", "edits", "row")

    def __init__(self, parent, edits, row):
        self.parent, self.children, self.held, self.edits, self.row = parent, [], False, edits, row
        if parent is not None:
            parent.children.append(self)


class Viterbi:
    """Rows of one conversation in, edits out as soon as every survivor shares them.

    For each state of the output one survivor is kept, a leaf of a tree of back pointers. Nodes
    without a reference go; when the root has one child left, its edits are final. Survivors of
    equal cost are told apart by their whole edit strings: each has all rows behind it and ends
    with the edit of a row, so none starts with another, and `rank`, the order of these strings,
    carries over to whatever is added. Only the part that is still open is in memory.
    """

    def __init__(self, emit, table: dict):
        self.table = table  # the moves by kind of row, shared by all conversations of a task
        self.emit, self.root, self.out, self.closed = emit, _Node(None, "", None), NOTHING, 0
        self.root.held = True
        self.alive = {NOTHING: (0, 0, self.root)}  # state -> cost, rank, leaf

    def add(self, row, initial: str, must_go: bool, truncated: bool) -> None:
        best: dict = {}
        kind = (initial, must_go, truncated)
        if kind not in self.table:
            self.table[kind] = moves(*kind)
        for a, b, cost, edits in self.table[kind]:
            if a in self.alive:
                so_far, rank, _ = self.alive[a]
                key = (so_far + cost, rank, edits, a)
                if b not in best or key < best[b]:
                    best[b] = key
        for x, y, more in BOUNDS:
            if x in best and y in best and best[x][0] > best[y][0] + more:
                del best[x]
        ranks = {key[1:3]: n for n, key in enumerate(sorted(best.values(), key=lambda k: k[1:3]))}
        before = self.alive
        self.alive = {}
        for b, (cost, rank, edits, a) in best.items():
            leaf = _Node(before[a][2], edits, row)
            leaf.held = True
            self.alive[b] = (cost, ranks[rank, edits], leaf)
        for _, _, leaf in before.values():
            leaf.held = False
            self._release(leaf)
        while not self.root.held and len(self.root.children) == 1:
            self._close(self.root.children[0])

    def _release(self, node) -> None:
        while node is not self.root and not node.held and not node.children:
            node.parent.children.remove(node)
            node = node.parent

    def _close(self, node) -> None:
        node.parent = None
        self.root = node
        self._write(node.edits, node.row)

    def _write(self, edits, row) -> None:
        for edit in edits:
            role, text = (None, "") if edit == "I" else row
            if edit in "IR":
                self.out = _next(self.out)
                role = ROLE[self.out]
            elif edit == "K":
                self.out = SYSTEM if role[:1] == "s" else _next(self.out)
            self.emit(edit, role, text)

    def finish(self) -> int:
        """Writes the rest of the cheapest path and returns its cost."""
        ends = [(c + INSERT * len(CLOSING[s]), rank, CLOSING[s], s) for s, (c, rank, _) in self.alive.items()]
        cost, _, inserts, state = min(ends)
        leaf, path = self.alive[state][2], []
        while leaf is not self.root:
            path.append(leaf)
            leaf = leaf.parent
        for node in reversed(path):
            self._write(node.edits, node.row)
        self._write(inserts, None)
        return cost


EDITS = "seq long, edit string, role string, text string"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SUMMARY = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


class _Conversation:
    """Counts, digest and edits of one conversation, row by row."""

    def __init__(self, key, sink, table):
        self.key, self.sink, self.n, self.last = key, sink, 0, None
        self.counts = dict.fromkeys(COUNTS, 0)
        self.turns, self.low, self.high = 0, None, None
        self.audit, self.digest, self.first = bytearray(), hashlib.sha256(), True
        self.viterbi = Viterbi(self._edit, table)

    def _edit(self, edit, role, text):
        self.audit += edit.encode()
        if edit != "D":
            line = f"{role}:{text}" if self.first else f"\n{role}:{text}"
            self.digest.update(line.encode("utf-8", "replace"))
            self.first = False
        if self.sink is not None:
            self.sink((self.key, self.n, edit, role, text))
        self.n += 1

    def add(self, turn, role, text, fault):
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.last = initial
        if turn is not None:
            if self.low is None:
                self.low = turn
            if turn != self.high:
                self.turns += 1
            self.high = turn
        self.viterbi.add((role, text), initial, fault in ("blank", "duplicate"), fault == "truncated")

    def end(self):
        self.counts["cost"] = self.viterbi.finish()
        if self.turns:
            self.counts["gaps"] = min(BIGGEST, self.high - self.low + 1 - self.turns)
        return (self.key, *(self.counts[c] for c in COUNTS), self.audit.decode(), self.digest.hexdigest())


def faults(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, seen, fault): the first fault of each row, in one shuffle by conversation.

    Blank: no character but space and \\t to \\r; duplicate: role and text seen earlier by turn;
    truncated: the last such character is not `.`, `!` or `?`. Null roles and texts are one
    space, null turns come first, equal turns go by role and text.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    ).repartition("conv_id")
    seen = F.row_number().over(W.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn")))
    fault = (
        F.when(~F.col("text").rlike(CHARACTER), "blank")
        .when(F.col("seen") > 1, "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    return rows.withColumn("seen", seen).withColumn("fault", fault)


def _run(turns: DataFrame, edits: bool, **names) -> DataFrame:
    rows = faults(turns, **names).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "seen").drop("seen")
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {EDITS if edits else SUMMARY}"
    columns = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        now, types, table = None, None, {}

        def packed(found):
            columns_of = zip(*found) if found else [[] for _ in columns]
            return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns_of, types)], columns)

        for batch in batches:
            key_type = batch.schema.field("conv_id").type
            rest = [pa.int64()] + [pa.string()] * 3 if edits else [pa.int64()] * len(COUNTS) + [pa.string()] * 2
            types = [key_type, *rest]
            found: list = []
            sink = found.append if edits else None
            if now is not None:
                now.sink = sink
            for key, *row in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "fault"))):
                if now is None or now.key != key:
                    if now is not None:
                        summary = now.end()
                        if not edits:
                            found.append(summary)
                    now = _Conversation(key, sink, table)
                now.add(*row)
            yield packed(found)
        if now is not None:
            found = []
            now.sink = found.append if edits else None
            summary = now.end()
            yield packed(found if edits else [summary])

    return rows.mapInArrow(run, schema)


def repair(turns: DataFrame, **names) -> DataFrame:
    """The edits of every conversation, in order: conv_id, seq, edit (K, R, D, I), role, text.

    Rows other than deletions are the repaired conversation. Rows are shuffled and sorted by
    conversation and read as a stream; a task holds one conversation's undecided rows, not the
    conversation. Null ids are one conversation; other columns are not read; repeated rows are
    duplicates; no rows give no rows. `names` gives other column names (conv, turn, role, text).
    """
    return _run(turns, True, **names)


def audit(turns: DataFrame, **names) -> DataFrame:
    """One row per conversation: counts of faults, cost, audit (its edits) and the repair's hash.

    Like `repair`, with the same odd input; the hash is over `role:text` lines of what stays.
    """
    return _run(turns, False, **names)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of `conv_id:turn` modulo 20; nulls count as one space."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))

    def part(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = conversations.select(
        "conv_id", "turn", kind.alias("kind"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    ).where("kind <> 0")
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")


def op13_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation, damaged and repaired; those without a row left have zeros."""
    conversations = spark.read.parquet(f"{sf}/conversations.parquet")
    found = audit(damage(conversations)).withColumnRenamed("conv_id", "id")
    ids = conversations.select("conv_id").distinct()
    nothing = {**dict.fromkeys(COUNTS, 0), "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    filled = [F.coalesce(F.col(c), F.lit(v).cast("long" if v == 0 else "string")).alias(c) for c, v in nothing.items()]
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").select("conv_id", *filled)


def _sql() -> str:
    """Recursion over the rows of all conversations: per state the least (cost, audit, lines)."""

    def add(state: str, cost: str, edit: str, line: str = "''") -> str:
        return f"{{c: {state}.c + {cost}, a: {state}.a || '{edit}', t: {state}.t || {line}}}"

    def least(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    none = "{c: 1000000000::BIGINT, a: '', t: ''}"

    def when(test: str, value: str) -> str:
        return f"CASE WHEN {test} THEN {value} ELSE {none} END"

    kept, user, helper = "chr(10) || role || ':' || txt", "chr(10) || 'user:' || txt", "chr(10) || 'assistant:' || txt"
    more, stay = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END", "fault NOT IN ('blank', 'duplicate')"
    before_user = ("s0", "s1", "s3")
    to_user = [when(f"{stay} AND ini = 'u'", add(s, more, "K", kept)) for s in before_user]
    to_user += [when(stay, add(s, f"3 + {more}", "R", user)) for s in before_user]
    step = f"""
      {add('s0', '4', 'D')} AS d0,
      {least(add('s1', '4', 'D'), when(stay + " AND ini = 's'", add('s0', more, 'K', kept)))} AS d1,
      {least(add('s2', '4', 'D'), *to_user)} AS d2,
      {least(add('s3', '4', 'D'), when(stay + " AND ini = 'a'", add('s2', more, 'K', kept)), when(stay, add('s2', '3 + ' + more, 'R', helper)))} AS d3"""
    inserted = [add(s, "3", "I", "chr(10) || 'user:'") for s in ("d0", "d1", "d3")]
    return rf"""
WITH RECURSIVE bits AS (
  SELECT i AS byte, i::BIGINT AS v, 0 AS k FROM range(256) AS r(i)
  UNION ALL
  SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY byte) AS t FROM bits WHERE k = 8),
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations),
hashed AS (
  SELECT src.*, xor(list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::BIGINT)),
           lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM src, tab),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END AS txt,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE kind <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt, seen) AS i
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY turn NULLS FIRST) AS seen FROM damaged)),
rows_ AS (
  SELECT *, substr(role, 1, 1) AS ini,
         CASE WHEN NOT regexp_matches(txt, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(txt, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS ahead
  FROM ordered),
counts AS (
  SELECT conv_id,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (ahead IS NOT NULL AND ahead || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM rows_ GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{c: 0::BIGINT, a: '', t: ''}} AS s0, {none} AS s1,
         {{c: 3::BIGINT, a: 'I', t: chr(10) || 'user:'}} AS s2,
         {{c: 6::BIGINT, a: 'II', t: chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3
  FROM counts
  UNION ALL
  SELECT conv_id, i, d0, d1, u, {least('d3', add('u', '3', 'I', "chr(10) || 'assistant:'"))}
  FROM (SELECT *, {least('d2', *inserted)} AS u
        FROM (SELECT rows_.conv_id, rows_.i, {step}
              FROM walk JOIN rows_ ON rows_.conv_id IS NOT DISTINCT FROM walk.conv_id AND rows_.i = walk.i + 1))),
done AS (
  SELECT counts.*, {least('s0', 's3')} AS e
  FROM counts JOIN walk ON walk.conv_id IS NOT DISTINCT FROM counts.conv_id AND walk.i = counts.n)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.c, 0) AS cost,
       coalesce(e.a, '') AS audit, sha256(coalesce(substr(e.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id
"""


SQL_REPAIR = _sql()
