"""Repair of conversation structure by a streaming dynamic program.

Rows are repartitioned by conversation and sorted by turn (nulls first; equal turns by role,
then text), and a mapInPandas function walks them. What it carries from one Arrow batch to the
next is small: for each of four states of the grammar (nothing yet, after the system row, after
a user row, after an assistant row) the least cost of the rows so far, the order of the edit
strings that reach it, and a running hash of the repaired rows. Any conversation takes the same
memory: backpointers, three bytes a row, are written out as rows of a staged table for each
``chunk_rows`` rows, and a second pass reads them last chunk first to find the edits. Edits are
applied chunk by chunk, so that the texts of a giant conversation meet them in many tasks. Only
the walk itself, like the hash, goes through a conversation in order in one task.

A row has one fault at most: blank (nothing but space and 0x09-0x0D), duplicate (role and text
of an earlier row), truncated (the last other character is none of ``.!?``). Edits of a row are
Keep (0), Rerole to user or assistant (2), Delete (3); blank and duplicate rows must go, and a
truncated row that stays adds 1. Insert (2) puts an empty user or assistant row anywhere. The
initials of the roles left spell ``(s?(ua)+)?``. Of the cheapest edits those whose initials come first in
ASCII are taken; they leave one result.

Nulls in role or text count as one space. A null conversation id is a conversation. An empty
table gives no rows. Repeated rows are duplicates, other rows with equal turns all count. Other
columns take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_table

#: Rows of a conversation whose backpointers are held before they are written out.
CHUNK_ROWS = 1 << 16

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
LETTERS = "DKR"
ROLES = {USER: "user", ASSISTANT: "assistant"}
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEEPS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: Inserts that complete a conversation from each state.
COMPLETE = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: A state this much dearer than the cheapest is never on a cheapest way: five at most lead from one to another's place.
HOPELESS = 6

#: Costs above the cheapest (None: not reached) and places in the order of edit strings, for the four states.
START = ((0, None, None, None), (0, 0, 0, 0))

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
STREAM = f"key string, part long, seq long, role binary, text binary, back binary, actions array<string>, state int, {RESULT}"


def _inserts(state: int) -> list[tuple[int, int]]:
    """How many rows to insert, and the state they lead to; a state is never entered twice."""
    out, seen = [], set()
    while state not in seen:
        seen.add(state)
        out.append((len(out), state))
        state = NEXT[state]
    return out


@lru_cache(maxsize=None)
def step(place: tuple, kind: str, forced: bool, truncated: bool):
    """The next place, what the cheapest cost grows by, and for each state reached: (from, inserts, letter)."""
    costs, ranks = place
    best: dict[int, tuple] = {}
    for source in range(4):
        if costs[source] is None:
            continue
        for inserts, middle in _inserts(source):
            edits = [("D", middle, DELETE)]
            if not forced:
                edits.append(("R", NEXT[middle], REROLE + TRUNCATED * truncated))
                if (middle, kind) in KEEPS:
                    edits.append(("K", KEEPS[middle, kind], KEEP + TRUNCATED * truncated))
            for letter, state, cost in edits:
                way = (costs[source] + INSERT * inserts + cost, ranks[source], "I" * inserts + letter, source, inserts, letter)
                best[state] = min(best.get(state, way), way)
    least = min(way[0] for way in best.values())
    kept = {s: way for s, way in best.items() if way[0] <= least + HOPELESS}
    order = sorted(kept, key=lambda s: kept[s][1:3])
    after = tuple(kept[s][0] - least if s in kept else None for s in range(4))
    return (after, tuple(order.index(s) if s in kept else 0 for s in range(4))), least, {s: way[3:] for s, way in kept.items()}


def finish(place: tuple) -> tuple[int, int]:
    """The state to end in and the cost above the cheapest, completion included."""
    costs, ranks = place
    cost, _, _, state = min((c + INSERT * COMPLETE[s], ranks[s], COMPLETE[s], s) for s, c in enumerate(costs) if c is not None)
    return state, cost


@lru_cache(maxsize=None)
def pack(place: tuple, kind: str, forced: bool, truncated: bool) -> bytes:
    """The backpointers of a step: for each state two bits each of source, inserts and letter."""
    code = 0
    for state, (source, inserts, letter) in step(place, kind, forced, truncated)[2].items():
        code |= (source | inserts << 2 | LETTERS.index(letter) << 4) << 6 * state
    return code.to_bytes(3, "little")


def inserted(state: int, inserts: int) -> str:
    """``u`` and ``a`` for the rows inserted from a state on."""
    out = ""
    for _ in range(inserts):
        state = NEXT[state]
        out += ROLES[state][0]
    return out


def trace(back: bytes, state: int) -> tuple[list[str], int]:
    """Actions of a chunk's rows from the state it ends in, and the state it starts from.

    An action names inserted rows (``u``, ``a``), then the row's own edit: ``K``, ``D``, or ``U``
    and ``A`` for a new role.
    """
    out = []
    for at in range(len(back) - 3, -3, -3):
        code = int.from_bytes(back[at : at + 3], "little") >> 6 * state
        source, inserts, letter = code & 3, code >> 2 & 3, LETTERS[code >> 4 & 3]
        out.append(inserted(source, inserts) + (ROLES[state][0].upper() if letter == "R" else letter))
        state = source
    return out[::-1], state


def audit_of(actions: list[str]) -> str:
    return "".join(actions).translate(str.maketrans("uaUA", "IIRR"))


class Walk:
    """One conversation, row after row."""

    def __init__(self):
        self.place, self.cost, self.rows, self.part = START, 0, 0, 0
        self.hashes = {NOTHING: hashlib.sha256()}
        self.back = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.initial, self.turn, self.first_turn = None, None, None

    def add(self, turn: int | None, role: bytes, text: bytes, repeated: bool) -> None:
        filled = text.rstrip()
        blank = not filled
        truncated = not blank and not repeated and filled[-1:] not in (b".", b"!", b"?")
        self.blank += blank
        self.duplicate += repeated and not blank
        self.truncated += truncated
        initial = role[:1].decode("ascii", "replace")
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turn, self.turns = turn, self.turns + 1
        kind = initial if initial in ("s", "u", "a") else ""
        forced = blank or repeated
        self.back += pack(self.place, kind, forced, truncated)
        self.place, grown, ways = step(self.place, kind, forced, truncated)
        self.cost += grown
        self.rows += 1
        hashes = {}
        for state, (source, inserts, letter) in ways.items():
            hashes[state] = self.hashes[source]
            if inserts or letter != "D":
                lines = [b"assistant:" if r == "a" else b"user:" for r in inserted(source, inserts)]
                if letter != "D":
                    lines.append((role if letter == "K" else ROLES[state].encode()) + b":" + text)
                hashes[state] = self._hash(source, lines)
        self.hashes = hashes

    def _hash(self, source: int, lines: list[bytes]):
        out = self.hashes[source].copy()
        out.update((b"" if source == NOTHING else b"\n") + b"\n".join(lines))
        return out

    def chunk(self) -> dict:
        out = {"part": self.part, "back": bytes(self.back)}
        self.back, self.part = bytearray(), self.part + 1
        return out

    def end(self) -> dict:
        state, more = finish(self.place)
        ending = inserted(state, COMPLETE[state])
        lines = [b"assistant:" if r == "a" else b"user:" for r in ending]
        digest = self._hash(state, lines) if lines else self.hashes[state]
        gaps = self.turn - self.first_turn + 1 - self.turns if self.turns else 0
        out = {
            "part": self.part,
            "state": state,
            "gaps": gaps,
            "blank": self.blank,
            "duplicate": self.duplicate,
            "truncated": self.truncated,
            "illegal": self.illegal,
            "cost": self.cost + more,
            "repaired_sha256": digest.hexdigest(),
        }
        if self.part:
            return {**out, "back": bytes(self.back)}
        actions = [*trace(bytes(self.back), state)[0], ending]
        return {**out, "actions": actions, "audit": audit_of(actions)}


def _frame(rows: list[dict]) -> pd.DataFrame:
    names = [c.split()[0] for c in STREAM.split(", ")]
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in names})


def walk(batches: Iterator[pd.DataFrame], chunk_rows: int, texts: bool) -> Iterator[pd.DataFrame]:
    """Chunks and results of sorted conversations; with ``texts`` also their rows, numbered."""
    key = before = now = None
    for batch in batches:
        out = []
        for row in zip(*(batch[c].tolist() for c in ("key", "has_turn", "turn", "role", "text", "times", "seen"))):
            if row[0] != key:
                if now is not None:
                    out.append({"key": key, **now.end()})
                key, before, now = row[0], None, Walk()
            _, has_turn, turn, role, text, times, seen = row
            turn = turn if has_turn else None
            for copy in range(times):
                if len(now.back) == 3 * chunk_rows:
                    out.append({"key": key, **now.chunk()})
                if texts:
                    out.append({"key": key, "part": now.part, "seq": now.rows, "role": role, "text": text})
                now.add(turn, role, text, seen or before == (turn, role, text))
                before = (turn, role, text)
        if out:
            yield _frame(out)
    if now is not None:
        yield _frame([{"key": key, **now.end()}])


def walk_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Actions of the chunks of conversations that come last chunk first."""
    state = None
    for batch in batches:
        out = []
        for key, part, back, end in zip(*(batch[c].tolist() for c in ("key", "part", "back", "end"))):
            last = end >= 0
            ending = inserted(end, COMPLETE[end]) if last else ""
            actions, state = trace(back, end if last else state)
            out.append((key, part, [*actions, ending] if last else actions, audit_of([*actions, ending])))
        yield pd.DataFrame(out, columns=["key", "part", "actions", "audit"])


def damage(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, by crc32 of ``conv_id:turn``; ``times`` says how often a row occurs (0: dropped)."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    code = F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(code == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(code == 1, F.lit("")).when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("times"),
    )


def _place() -> Column:
    return F.struct(F.col("has_turn"), F.col("turn"))


def _stream(rows: DataFrame, conv_id: str, times: str | None, chunk_rows: int, texts: bool) -> DataFrame:
    """The staged output of the walk."""
    one_space = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")}
    conv = F.col(f"`{conv_id}`").cast("string")
    rows = rows.select(
        F.when(conv.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), conv)).alias("key"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long")).alias("turn"),
        one_space["role"].alias("role"),
        one_space["text"].alias("text"),
        (F.col(times) if times else F.lit(1)).cast("int").alias("times"),
    )
    # A row is seen earlier if its text has an earlier turn too; equal turns lie side by side and are left to the walk.
    sizes = [F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)) for c in ("key", "role")]
    rows = rows.withColumn("digest", F.unhex(F.md5(F.concat(*sizes, F.col("text")).cast("binary"))))
    spans = rows.filter("times > 0").groupBy("digest").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"))
    earlier = stage_table(spans.filter("first <> last").select("digest", "first"), "conversation-repeats")
    flagged = rows.join(earlier, "digest", "left").select(
        "key", "has_turn", "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "times", F.coalesce(_place() > F.col("first"), F.lit(False)).alias("seen")
    )
    ordered = flagged.repartition("key").sortWithinPartitions("key", "has_turn", "turn", "role", "text")
    return stage_table(ordered.mapInPandas(lambda batches: walk(batches, chunk_rows, texts), STREAM), "conversation-walk")


def _traced(staged: DataFrame) -> DataFrame:
    """(key, part, actions, audit) of the chunks that were written out."""
    spilled = staged.filter("back is not null").select("key", "part", "back", F.coalesce("state", F.lit(-1)).alias("end"))
    ordered = spilled.repartition("key").sortWithinPartitions("key", F.desc("part"))
    return ordered.mapInPandas(walk_back, "key string, part long, actions array<string>, audit string")


def _named(key: Column, like: DataFrame, conv_id: str) -> Column:
    kind = dict(like.select(F.col(f"`{conv_id}`").alias("c")).dtypes)["c"]
    return F.when(key != "", F.substr(key, F.lit(2))).cast(kind).alias("conv_id")


def audit(rows: DataFrame, conv_id: str = "conv_id", times: str | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row for each conversation: its faults, the edits' cost and initials, and the hash of what they leave.

    ``rows`` has conv_id, turn, role and text; ``times``, if given, names how often a row
    occurs, and a row of 0 times only names its conversation. ``gaps`` counts turns that are
    missing between the smallest and the largest.
    """
    staged = _stream(rows, conv_id, times, chunk_rows, texts=False)
    found = staged.filter("cost is not null")
    audits = _traced(staged).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "audit"))).alias("parts"))
    audits = audits.select("key", F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("long_audit"))
    giants = found.filter("part > 0").join(audits, "key").withColumn("audit", F.col("long_audit")).select(found.columns)
    names = [c.split()[0] for c in RESULT.split(", ")]
    return found.filter("part = 0").unionByName(giants).select(_named(F.col("key"), rows, conv_id), *names)


def repair(rows: DataFrame, conv_id: str = "conv_id", times: str | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The repaired conversations: (conv_id, seq, step, role, text, edit), in the order of seq and step.

    ``edit`` is Keep, Rerole or Insert; deleted rows are left out. ``seq`` counts a conversation's
    rows before the repair; inserted rows have that of the row they precede.
    """
    staged = _stream(rows, conv_id, times, chunk_rows, texts=True)
    lines = staged.filter("seq is not null").select("key", "part", "seq", "role", "text")
    # The inserts that end a conversation are one more action, behind its last row.
    chunks = staged.filter("actions is not null").select("key", "part", "actions").unionByName(_traced(staged).drop("audit"))
    edits = chunks.select("key", "part", F.posexplode("actions").alias("at", "action"))
    edits = edits.select("key", "part", (F.col("part") * chunk_rows + F.col("at")).alias("seq"), "action")
    met = edits.join(lines, ["key", "part", "seq"], "left")
    steps = met.select("key", "seq", "role", "text", F.posexplode(F.filter(F.split("action", ""), lambda x: x != "")).alias("step", "edit"))
    role = F.when(F.lower("edit") == "u", F.lit("user")).when(F.lower("edit") == "a", F.lit("assistant")).otherwise(F.col("role").cast("string"))
    added = F.col("edit").isin("u", "a")
    kind = F.when(added, "Insert").when(F.col("edit") == "K", "Keep").otherwise("Rerole")
    return steps.filter("edit <> 'D'").select(
        _named(F.col("key"), rows, conv_id), "seq", "step", role.alias("role"), F.when(added, F.lit("")).otherwise(F.col("text").cast("string")).alias("text"), kind.alias("edit")
    )
