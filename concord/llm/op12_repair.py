"""Repair of conversations: each distinct signature of roles and faults is solved once, and its edits replayed.

A conversation's rows in order become a string of one letter each: the role's initial, s, u, a
or x for any other, in upper case where the text is cut off, and d where the row must go. The
distinct strings are solved, far fewer than conversations; the audits, strings of edits, are
joined back and replayed over the rows, streamed in order. What is held of a conversation is
its signature and audit, a byte a row, and never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.batches import slices, small_batches, tidy
from concord.plans.shared import cut, free, scratch

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: What has been put out so far: nothing, a system row, a user's row last, an assistant's row last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a row made or named anew leads, and where a row kept leads, by its letter.
_ANEW = (USER, USER, ASSISTANT, USER)
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_NEVER = 1 << 60


def solve(signature: str) -> tuple[int, str]:
    """The least cost, and of the audits that have it the least in ASCII order.

    best(i, state), the least cost of rows i and on, is a memoised recursion; it is asked for
    from the end, so that it never goes deep. More than two rows are never put in at one place.
    """
    n = len(signature)
    memo: list[int | None] = [None] * (4 * (n + 1))

    def moves(i: int, state: int) -> Iterator[tuple[str, int, int]]:
        """Edits of row i in ASCII order: letter, cost, the state after."""
        code = signature[i].lower()
        yield "D", DELETE, state
        if code != "d":
            more = TRUNCATED * signature[i].isupper()
            if state in _KEPT.get(code, ()):
                yield "K", more, _KEPT[code][state]
            yield "R", REROLE + more, _ANEW[state]

    def on(i: int, state: int) -> int:
        """best() where nothing is put in before row i."""
        if i == n:
            return 0 if state in (START, ASSISTANT) else _NEVER
        return min(cost + best(i + 1, after) for _, cost, after in moves(i, state))

    def best(i: int, state: int) -> int:
        if (known := memo[4 * i + state]) is None:
            one = _ANEW[state]
            known = memo[4 * i + state] = min(on(i, state), INSERT + on(i, one), 2 * INSERT + on(i, _ANEW[one]))
        return known

    for i in range(n, -1, -1):
        for state in range(4):
            best(i, state)
    audit, i, state = [], 0, START
    while i < n or state not in (START, ASSISTANT):
        options = [] if i == n else [(letter, cost, i + 1, after) for letter, cost, after in moves(i, state)]
        options.insert(min(1, len(options)), ("I", INSERT, i, _ANEW[state]))
        goal = best(i, state)
        letter, _, i, state = next(o for o in options if o[1] + best(o[2], o[3]) == goal)
        audit.append(letter)
    return best(0, START), "".join(audit)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (x for whole in batches for x in slices(whole, column=0)):
        found = [solve(s) for s in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["signature", "cost", "audit"])


FAULTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"


class _Signature:
    """Counts and letters of one conversation while its rows go by."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.role = None
        self.letters = bytearray()

    def add(self, turn: int | None, role: str, n: int, blank: bool, cut_off: bool, seen: bool) -> None:
        """n rows that are the same in turn, role and text."""
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        if self.role is not None:
            self.illegal += self.role + role not in ("su", "ua", "au")
        self.illegal += n - 1
        self.role = role
        if blank:
            self.blank += n
            self.letters += b"d" * n
        else:
            self.duplicate += n - (not seen)
            if not seen:
                self.truncated += cut_off
                code = role if role in ("s", "u", "a") else "x"
                self.letters += (code.upper() if cut_off else code).encode()
            self.letters += b"d" * (n - (not seen))

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.letters.decode()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], [name for name, _ in fields])


def _in_parts(rows: Iterator[tuple], schema: str, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Batches of some megabytes, or of one row."""
    out, room = [], 1 << 21
    for row in rows:
        out.append(row)
        room -= size(row)
        if room < 0:
            yield _batch(out, schema)
            out, room = [], 1 << 21
    if out:
        yield _batch(out, schema)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, turn, role, n, blank, cut_off, seen) -> FAULTS; n of 0 only names the conversation."""

    def conversations() -> Iterator[tuple]:
        now = None
        for batch in batches:
            for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        yield now.row()
                    now = _Signature(conv_id)
                if row[2]:
                    now.add(*row)
        if now is not None:
            yield now.row()

    return _in_parts(conversations(), FAULTS, lambda r: 64 + len(r[-1]))


class _Replay:
    """Applies an audit to a conversation's rows as they go by; put takes the rows that are left, with their edits."""

    def __init__(self, audit: str, put: Callable[[str, str, str], None]) -> None:
        self.audit, self.put, self.at, self.state = audit, put, 0, START

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._anew("", "I")

    def _anew(self, text: str, edit: str) -> None:
        self.state = _ANEW[self.state]
        self.put(_NAMES[self.state], text, edit)
        self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        if edit == "R":
            self._anew(text, edit)
            return
        self.at += 1
        if edit == "K":
            self.state = _KEPT[role[0]][self.state]
            self.put(role, text, edit)

    end = _insert


AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "conv_id long, place long, role string, text string, edit string"
_STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _hasher() -> tuple[hashlib._Hash, Callable[[str, str, str], None]]:
    """A SHA-256 and what takes rows into it, as `role:text` joined by line feeds."""
    h, between = hashlib.sha256(), b""

    def put(role: str, text: str, _: str) -> None:
        nonlocal between
        h.update(between + f"{role}:{text}".encode())
        between = b"\n"

    return h, put


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads, each followed by its conversation's rows -> AUDITS."""

    def conversations() -> Iterator[tuple]:
        now = head = h = None
        for batch in (x for whole in batches for x in slices(whole, column=2)):
            for kind, role, text, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind:
                    now.row(role, text)
                    continue
                if now is not None:
                    now.end()
                    yield *head, h.hexdigest()
                head, (h, put) = (rest[0], *rest[2:], rest[1]), _hasher()
                now = _Replay(rest[1], put)
        if now is not None:
            now.end()
            yield *head, h.hexdigest()

    return _in_parts(conversations(), AUDITS, lambda r: 200 + len(r[-2]))


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads, each followed by its conversation's rows -> REPAIRED."""

    def rows() -> Iterator[tuple]:
        out: list[tuple] = []
        now = None
        for batch in (x for whole in batches for x in slices(whole, column=2)):
            for kind, role, text, conv_id, audit, *_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind:
                    now.row(role, text)
                else:
                    if now is not None:
                        now.end()
                    yield from out
                    out.clear()
                    place = iter(range(1 << 62))
                    now = _Replay(audit, lambda role, text, edit, i=conv_id, place=place: out.append((i, next(place), role, text, edit)))
                yield from out
                out.clear()
        if now is not None:
            now.end()
            yield from out

    return _in_parts(rows(), REPAIRED, lambda r: 64 + len(r[3]))


def damage(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) with rows dropped, emptied, cut off, repeated and named user, by a hash of `conv_id:turn`; nulls in it, in role and in text count as one space."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    k = F.crc32(key.cast("binary")) % 20
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(k == 0, 0).when(k == 3, 2).otherwise(1)
    return turns.select("conv_id", "turn", F.when(k == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("copy"), copies.alias("copies")).where("copy <= copies").drop("copy", "copies")


def _solved(turns: DataFrame, conversations: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(turns with their digests, a row for each conversation with its counts, cost and audit)."""
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).withColumn("digest", F.sha2("text", 256))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut_off = ~blank & ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    # rows that repeat in all count down before they meet
    keys = rows.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("n"), F.max(blank).alias("blank"), F.max(cut_off).alias("cut_off"))
    keys = cut(keys, "repair-keys")
    same = ("conv_id", "role", "digest")
    again = keys.groupBy(*same).agg(F.count("*").alias("turns"), F.max(F.col("turn").isNull()).alias("any"), F.min("turn").alias("least")).where("turns > 1")
    again = cut(again.toDF("c", "r", "d", "turns", "any", "least").drop("turns"), "repair-again")
    met = keys.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    seen = F.col("r").isNotNull() & F.when(F.col("any"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least"))
    names = ("conv_id", "turn", "role", "digest", "n", "blank", "cut_off", "seen")
    marked = met.select("conv_id", "turn", F.substring("role", 1, 1).alias("role"), F.concat("role", F.lit("\0"), "digest").alias("digest"), "n", "blank", "cut_off", seen.alias("seen"))
    if conversations is not None:
        ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        marked = marked.unionByName(ids.select("conv_id", *(F.lit(v).cast(k).alias(c) for c, k, v in zip(names[1:], ("long", "string", "string", "long", "boolean", "boolean", "boolean"), (None, "", "", 0, False, False, False), strict=True))))
    marked = marked.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest")
    faults = cut(marked.select("conv_id", "turn", "role", "n", "blank", "cut_off", "seen").mapInArrow(tidy(_signatures), FAULTS), "repair-faults")
    free(keys, again)
    audits = cut(faults.select("signature").distinct().mapInArrow(tidy(_solve), "signature string, cost long, audit string"), "repair-audits")
    return rows, faults.join(audits, "signature").drop("signature")


def _replayed(turns: DataFrame, conversations: DataFrame | None, run: Callable, schema: str) -> DataFrame:
    small_batches(turns.sparkSession)
    with scratch() as made:
        rows, solved = _solved(turns, conversations)
        solved = made.keep(cut(solved, "repair-solved"))
    kinds = dict(rows.dtypes) | dict(solved.dtypes) | {"kind": "int"}
    columns = ("kind", "role", "text", "conv_id", "audit", *_STATS, "turn", "digest")
    none = lambda df: [F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns]
    heads, rows = solved.withColumn("kind", F.lit(0)), rows.withColumn("kind", F.lit(1))
    both = heads.select(*none(heads)).unionByName(rows.select(*none(rows)))
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), F.concat("role", F.lit("\0"), "digest"))
    return both.select(*columns[: 5 + len(_STATS)]).mapInArrow(tidy(run), schema)


def audits(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation of turns(conv_id, turn, role, text), and per other conv_id of conversations: its counts of faults, the cost and audit of the cheapest repair, and the repaired rows' SHA-256.

    Rows go by turn, nulls first, then by role and the SHA-256 of the text: rows that repeat
    stand next to each other. Null roles and texts are one space, an empty role has no
    initial; the rows without a conv_id are a conversation of their own. A conversation
    without rows has zeros and an empty audit; empty tables give no rows. Other columns,
    whatever their names, are not read. The hash of a conversation is taken in order, so its
    rows pass through one task, streamed from a sort that spills.
    """
    return _replayed(turns, conversations, _digests, AUDITS)


def repaired(turns: DataFrame) -> DataFrame:
    """The rows that the cheapest repair leaves: conv_id, place (from 0), role, text, edit (K, R or I). Rows, ties and nulls are as in audits."""
    return _replayed(turns, None, _repaired, REPAIRED)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return audits(damage(turns), turns)
