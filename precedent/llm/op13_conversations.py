"""Cheapest repair of conversations by a suffix-shared automaton of their signatures.

Role initials of a repaired conversation read ``(s?(ua)+)?``.  A row is kept (0), given the
role user or assistant (2) or deleted (3; a must for blank rows and duplicates); empty user
and assistant rows can be put in anywhere (2 each); a truncated row that stays adds 1.

1. Equal rows (id, turn, role, text hash) are counted first, so copies of one row are one.
   A row repeats an earlier one if its (id, role, text hash) has a lesser turn; that is a
   grouped minimum joined back.
2. Rows become one letter each (role initial and first fault).  They are range-partitioned by
   (id, turn, role, hash), so a long conversation spreads over many tasks; each task strings
   its letters together, and a conversation's signature joins those strings: a byte a row.
3. Signatures, range-partitioned (with the id, so that a common one spreads) and sorted by
   their reversed text, are read by tasks as a stream.  Signatures that end alike follow each
   other and share the nodes of that end: a stack holds the nodes of the current end, a new
   signature adds those beyond what it shares with the one before, an equal one adds none.
   A node has, for each grammar state, the cost to go and the first letters of the best audit
   with a link to the next node's state.  Nodes whose costs differ by a constant and whose
   audits rank alike are one (a register of shapes, bounded by the grammar), so a node costs
   one look-up.
4. An id's audit and its rows meet in one sorted stream for the hash.  The hash of one
   conversation is one SHA-256 over all its text, so one task reads it, batch by batch, with
   nothing of it held but its audit.

Ties of cost take the audit least by ASCII.  No audit begins another one of equal cost, so
each node may keep its best only.

Defined results: null role and text are one space, as are nulls in the ``conv_id:turn`` of
``damage``; rows of null ``conv_id`` are one conversation; rows of equal turn go by role, then
by the text's MD5, and equal rows repeat each other; a conversation left without rows has zeros,
an empty audit and the hash of the empty string; an empty table gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precedent.llm.common import materialize, n_partitions

# Fixed values of the contract: costs of edits, and the grammar's states.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: state -> {role initial: next state}
ARCS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLES = "sua?"
OK, BLANK, DUPLICATE, CUT = range(4)
#: Letters that one task strings together at most before it starts another string.
SEGMENT = 1 << 16

KEY = ("conv_id", "turn", "role", "th")


def damage(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: 0 copies of a dropped row, 2 of a repeated one."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *said).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, r"[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def _same(left: str, right: str, names) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return out


def lettered(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, th, copies, code, repeats)`` for each distinct row: role and own fault as a
    number, and whether its role and text stand at a lesser turn."""
    last = F.substring(F.rtrim("text", F.lit("\x20\x09\x0A\x0B\x0C\x0D")), -1, 1)
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), OK).otherwise(CUT)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    rows = rows.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("th"), "copies",
                       (role * 4 + fault).alias("code"))
    rows = materialize(rows.groupBy(*KEY, "code").agg(F.sum("copies").alias("copies")), "conversation-rows")
    turn = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    first = rows.where("copies > 0").groupBy("conv_id", "role", "th").agg(F.min(turn).alias("first"))
    out = rows.alias("r").join(first.alias("f"), _same("r", "f", ("conv_id", "role", "th")), "left")
    later = F.struct(F.col("r.turn").isNotNull().alias("given"), F.col("r.turn").alias("turn")) > F.col("f.first")
    return out.select(*[F.col(f"r.{c}").alias(c) for c in (*KEY, "copies", "code")],
                      F.coalesce(later, F.lit(False)).alias("repeats"))


def letter(code: int) -> str:
    return chr(ord("A") + code)


def signatures(rows: DataFrame) -> DataFrame:
    """``(conv_id, signature, gaps)`` per conversation from ``lettered`` rows."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("nth", pa.int64()), ("letters", pa.string()),
                        ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64())])

    def string(batches):
        from pyspark import TaskContext

        part, nth, at, out = TaskContext.get().partitionId(), 0, None, []
        held, first, last, turns, size = [], None, None, 0, 0

        def close():
            return (at[0], part, nth, "".join(held), first, last, turns)

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for batch in batches:
            for conv, turn, copies, code, repeats in zip(
                    *[batch.column(c).to_pylist() for c in ("conv_id", "turn", "copies", "code", "repeats")]):
                if at is None or at[0] != conv or size >= SEGMENT:
                    if at is not None:
                        out.append(close())
                        nth += 1
                    at, held, first, last, turns, size = (conv,), [], None, None, 0, 0
                if not copies:
                    continue
                fault = code % 4
                again = code if fault == BLANK else code - fault + DUPLICATE
                held.append(letter(again if repeats else code) + letter(again) * (copies - 1))
                size += copies
                if turn is not None:
                    if first is None:
                        first = turn
                    turns += turn != last
                    last = turn
            if len(out) >= 4096:
                yield flush()
                out = []
        if at is not None:
            out.append(close())
        if out:
            yield flush()

    # Null ids and turns come first in both the ranges and the sort.
    ordered = rows.repartitionByRange(n_partitions(rows.sparkSession), *KEY).sortWithinPartitions(*KEY)
    parts = ordered.select(*KEY, "copies", "code", "repeats").mapInArrow(
        string, "conv_id long, part long, nth long, letters string, first_turn long, last_turn long, turns long")
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "part", "nth", "letters", "first_turn", "last_turn", "turns"))).alias("p"))
    # A turn at the end of one string and the beginning of the next counts once.
    told = F.filter("p", lambda s: s.turns > 0)
    whole = whole.withColumn("told", told)
    distinct = F.expr("""aggregate(told, 0L, (n, s) -> n + s.turns)
        - size(filter(sequence(0, size(told) - 1), i -> i > 0 and told[i].first_turn = told[i - 1].last_turn))""")
    gaps = F.when(F.size("told") > 0, F.expr("told[size(told) - 1].last_turn - told[0].first_turn + 1") - distinct)
    return whole.select("conv_id", F.concat_ws("", F.expr("transform(p, s -> s.letters)")).alias("signature"),
                        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"))


class Automaton:
    """Nodes of signatures read from their ends, on a stack; see the module's docstring.

    A shape is, per grammar state, (cost above the least one, rank of the audit)."""

    def __init__(self):
        ends = {}
        for state in range(4):
            tail, at = "", state
            while at not in ENDS:
                at = next(iter(ARCS[at].values()))
                tail += "I"
            ends[state] = tail
        order = sorted(set(ends.values()))
        self.tails = [ends[s] for s in range(4)]
        self.shapes: dict[tuple, int] = {}
        self.values: list[tuple] = []
        self.register: dict[tuple[int, str], tuple] = {}
        self.end = self._shape(tuple((INSERT * len(t), order.index(t)) for t in self.tails))
        # Per depth from the end: shape, least cost, and the moves of the node's states.
        self.word, self.stack = "", [(self.end, 0, None)]
        # Zero, one or two rows put in before a row; more would come back to the same state.
        self.before = {s: [(s, "")] for s in range(4)}
        for s in range(4):
            at = s
            for k in (1, 2):
                at = ARCS[at]["u" if "u" in ARCS[at] else "a"]
                self.before[s].append((at, "I" * k))

    def _shape(self, value: tuple) -> int:
        if value not in self.shapes:
            self.shapes[value] = len(self.values)
            self.values.append(value)
        return self.shapes[value]

    def _node(self, shape: int, sign: str) -> tuple:
        """``(shape, least cost added, moves)`` of the node that reads ``sign`` before a node of ``shape``."""
        key = (shape, sign)
        if key not in self.register:
            ahead = self.values[shape]
            role, fault = divmod(ord(sign) - ord("A"), 4)
            moves = []
            for state in range(4):
                best = None
                for at, letters in self.before[state]:
                    paid = INSERT * len(letters)
                    tries = [("D", at, DELETE)]
                    if fault in (OK, CUT):
                        extra = TRUNCATED * (fault == CUT)
                        to = ARCS[at].get(ROLES[role])
                        if to is not None:
                            tries.append(("K", to, extra))
                        tries += [("R", to, REROLE + extra) for r, to in ARCS[at].items() if r != "s"]
                    for edit, to, cost in tries:
                        found = (paid + cost + ahead[to][0], letters + edit, ahead[to][1], to)
                        if best is None or found < best:
                            best = found
                moves.append(best)
            least = min(m[0] for m in moves)
            order = sorted({(m[1], m[2]) for m in moves})
            shape = self._shape(tuple((m[0] - least, order.index((m[1], m[2]))) for m in moves))
            self.register[key] = (shape, least, tuple((m[1], m[3]) for m in moves))
        return self.register[key]

    def repair(self, signature: str) -> tuple[int, str]:
        """Cost and audit; signatures that share an end should follow each other."""
        word = signature[::-1]
        shared, top = 0, min(len(word), len(self.word))
        if word[:top] == self.word[:top]:
            shared = top
        else:
            lo, hi = 0, top                                     # the longest shared end, by halving
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if word[:mid] == self.word[:mid]:
                    lo = mid
                else:
                    hi = mid - 1
            shared = lo
        del self.stack[shared + 1:]
        self.word = word
        shape, cost, _ = self.stack[-1]
        for sign in word[shared:]:
            shape, added, moves = self._node(shape, sign)
            cost += added
            self.stack.append((shape, cost, moves))
        state, audit = START, []
        for _, _, moves in reversed(self.stack[1:]):
            letters, state = moves[state]
            audit.append(letters)
        audit.append(self.tails[state])
        return cost + self.values[shape][START][0], "".join(audit)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repairs(signs: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` from ``signatures``."""
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string())])

    def run(batches):
        automaton, last, found = Automaton(), None, None
        legal = {"su", "ua", "au"}
        for batch in batches:
            rows = []
            for conv, s, gaps in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "signature", "gaps")]):
                if s != last:
                    codes = [ord(c) - ord("A") for c in s]
                    roles = "".join(ROLES[c // 4] for c in codes)
                    faults = [c % 4 for c in codes]
                    last, found = s, (faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT),
                                      sum(x + y not in legal for x, y in zip(roles, roles[1:])), *automaton.repair(s))
                rows.append((conv, gaps, *found))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)],
                                                 schema=schema)

    # The id in the ranges parts conversations of one signature, however many.
    back = signs.withColumn("back", F.reverse("signature"))
    ordered = back.repartitionByRange(n_partitions(signs.sparkSession), "back", "conv_id").sortWithinPartitions("back")
    return ordered.mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string")


def with_hashes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (from ``repairs``) with ``repaired_sha256``, from the damaged ``rows``."""
    names = {"u": "user", "a": "assistant"}
    follow = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()),
                        ("repaired_sha256", pa.string())])

    class Writer:
        """One conversation's hash while its rows go by."""

        def __init__(self, conv, head):
            self.conv, self.head, self.audit, self.at, self.state = conv, head, head["audit"], 0, START
            self.hash, self.lines = hashlib.sha256(), 0

        def line(self, role, text):
            self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            self.lines += 1

        def put(self):
            while self.at < len(self.audit) and self.audit[self.at] == "I":
                initial, self.state = follow[self.state]
                self.line(names[initial], "")
                self.at += 1

        def row(self, role, text):
            self.put()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.state = ARCS[self.state][role[0]]
                self.line(role, text)
            elif edit == "R":
                initial, self.state = follow[self.state]
                self.line(names[initial], text)

        def end(self):
            self.put()
            return (self.conv, *[self.head[c] for c in COUNTS], self.audit, self.hash.hexdigest())

    def run(batches):
        writer, out = None, []
        for batch in batches:
            for conv, head, role, text, copies in zip(
                    *[batch.column(c).to_pylist() for c in ("conv_id", "head", "role", "text", "copies")]):
                if head is not None:
                    if writer is not None:
                        out.append(writer.end())
                    writer = Writer(conv, head)
                else:
                    for _ in range(copies):
                        writer.row(role, text)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if writer is not None:
            out.append(writer.end())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    head = F.struct(*COUNTS, "audit")
    empty = found.select(head.alias("head")).schema["head"].dataType
    body = rows.where("copies > 0").select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", F.unhex(F.md5("text")).alias("th"),
        F.lit(None).cast(empty).alias("head"), "text", "copies")
    heads = found.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("binary").alias("th"), head.alias("head"), F.lit(None).cast("string").alias("text"),
        F.lit(0).cast("long").alias("copies"))
    stream = body.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "th")
    return stream.mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS)
                             + ", audit string, repaired_sha256 string")


def repair(conversations: DataFrame, damaged: bool = False) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` per
    conversation of ``conversations(conv_id, turn, role, text)``; with ``damaged`` of its rows as
    ``damage`` changes them."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    if damaged:
        rows = damage(rows)
    else:
        rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                           F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).cast("long").alias("copies"))
    signs = materialize(signatures(lettered(rows)), "conversation-signatures")
    return with_hashes(rows, materialize(repairs(signs), "conversation-repairs"))
