"""Operator 13: conversations of faulty structure, repaired by iterative-deepening A* over edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .exchange import bounded_batches, part_count, written

#: What may follow which role, by initials; a conversation ends before it begins or after an assistant.
AFTER = {"": "su", "s": "u", "u": "a", "a": "u"}
ENDS = ("", "a")
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"

SEGMENT = 24  # Rows that one search covers.
PIECE_ROWS, PIECE_BYTES = 1024, 1 << 20  # Of a conversation that one row carries between tasks.
HOT_ROWS, HOT_KEYS = 10_000, 50_000


# -- search

# A row is one character: x must go (blank or repeated); s, u, a by its role's initial, o any other
# role; in capitals if it is truncated.


def _edits(sign: str, i: int, state: str) -> Iterator[tuple[str, int, int, str]]:
    """(letter, cost, next row, next state), in ASCII order of the letters."""
    row = sign[i : i + 1]
    if row:
        yield "D", DELETE, i + 1, state
    roles = [r for r in AFTER[state] if r in NAMES]
    for role in roles:
        yield "I", INSERT, i, role
    if row and row != "x":
        more, kind = TRUNCATED * row.isupper(), row.lower()
        if kind in AFTER[state]:
            yield "K", more, i + 1, kind
        for role in roles:
            yield "R", REROLE + more, i + 1, role


def _search(sign: str, state: str, goals: tuple[str, ...], least: list[int]) -> tuple[int, str]:
    """Cheapest cost from ``state`` over all rows to a goal, and the ASCII-least edits of that cost.

    Iterative deepening: depth-first search in the order of the letters, cut where cost so far and
    the least cost to come exceed the bound. The table keeps of each (row, state) whose search has
    failed the least cost that is still possible from there; it cuts later visits, and its entry for the
    start is the next bound. The first path within the bound is the answer: no cheaper one exists,
    and all ASCII-lesser ones of its cost were tried before.
    """
    failed: dict[tuple[int, str], int] = {}

    def visit(i: int, state: str, left: int) -> tuple[int, str | None]:
        low = failed.get((i, state), least[i])
        if low > left:
            return low, None
        if i == len(sign) and state in goals:
            return 0, ""
        best = None
        for letter, cost, j, then in _edits(sign, i, state):
            more, rest = visit(j, then, left - cost)
            if rest is not None:
                return cost + more, letter + rest
            best = cost + more if best is None else min(best, cost + more)
        failed[i, state] = max(low, left + 1, best)
        return failed[i, state], None

    bound = least[0]
    while True:
        cost, path = visit(0, state, bound)
        if path is not None:
            return cost, path
        bound = cost


@lru_cache(1 << 16)
def _least_of(block: str) -> int:
    """Least cost of a few rows whatever stands before and after them."""
    alone = [sum(DELETE if r == "x" else TRUNCATED if r.isupper() else REROLE if r == "o" else 0 for r in block[i:]) for i in range(len(block) + 1)]
    return min(_search(block, start, tuple(AFTER), alone)[0] for start in AFTER)


def _least(sign: str, block: int = 4) -> list[int]:
    """For each row a bound of the cost from it on: the sum over blocks of rows of what each costs at least."""
    out = [0] * (len(sign) + 1)
    for i in range(len(sign) - 1, -1, -1):
        end = min(len(sign), i - i % block + block)
        out[i] = _least_of(sign[i:end]) + out[end]
    return out


@lru_cache(1 << 15)
def cheapest_edits(sign: str) -> tuple[int, str]:
    """Of a whole conversation of a few rows."""
    return _search(sign, "", ENDS, _least(sign))


@lru_cache(1 << 15)
def _crossings(sign: str, state: str) -> dict[str, tuple[int, str]]:
    """Cheapest edits of a segment entered in ``state``, by each state in which it can be left."""
    goals = {state, "u", "a"} | ({"s"} if state == "" and "s" in sign.lower() else set())
    return {goal: _search(sign, state, (goal,), _least(sign)) for goal in goals}


def cheapest_chain(signs: Iterator[str]) -> tuple[int, list[str]]:
    """Cheapest edits of a conversation given by its segments, as one string a segment.

    Of each state between two segments the cheapest edits so far are kept, the ASCII-least of
    equal cost. Two such strings either differ at some place, which decides between all their
    continuations, or one is the other with a few insertions more; that tail is kept until it is decided.
    """
    costs: dict[str, int] = {"": 0}
    order: dict[tuple[str, str], int | tuple[str, str]] = {}
    layers = []

    def compare(a: tuple[str, str], b: tuple[str, str]) -> int | tuple[str, str]:
        """Of two (state, edits): -1 or 1 where decided, else what each has beyond the other."""
        (p, x), (q, y) = a, b
        if p != q:
            known = order[p, q]
            if isinstance(known, int):
                return known
            x, y = known[0] + x, known[1] + y
        k = min(len(x), len(y))
        if x[:k] != y[:k]:
            return -1 if x < y else 1
        return x[k:], y[k:]

    def before(a: tuple[str, str], b: tuple[str, str]) -> bool:
        known = compare(a, b)
        return known < 0 if isinstance(known, int) else len(known[0]) < len(known[1])

    for sign in signs:
        chosen: dict[str, tuple[str, str]] = {}
        then: dict[str, int] = {}
        for state, cost in costs.items():
            for goal, (more, edits) in _crossings(sign, state).items():
                total = cost + more
                if goal not in then or total < then[goal] or (total == then[goal] and before((state, edits), chosen[goal])):
                    then[goal], chosen[goal] = total, (state, edits)
        order = {(p, q): compare(chosen[p], chosen[q]) for p in chosen for q in chosen if p != q}
        costs = then
        layers.append(chosen)
    state = min((s for s in costs if s in ENDS), key=lambda s: costs[s])
    other = [s for s in costs if s in ENDS and s != state and costs[s] == costs[state]]
    for s in other:
        known = order.get((s, state), 1)
        if known == -1 or (isinstance(known, tuple) and len(known[0]) < len(known[1])):
            state = s
    cost, out = costs[state], []
    for chosen in reversed(layers):
        state, edits = chosen[state]
        out.append(edits)
    return cost, out[::-1]


def _segments(sign: str) -> list[str]:
    return [sign[i : i + SEGMENT] for i in range(0, len(sign), SEGMENT)]


def cheapest(sign: str) -> tuple[int, str]:
    """Cost and edits of a conversation of any length."""
    if len(sign) <= SEGMENT:
        return cheapest_edits(sign)
    cost, parts = cheapest_chain(iter(_segments(sign)))
    return cost, "".join(parts)


class Repair:
    """Applies edits to rows in order; keeps the state between calls."""

    def __init__(self) -> None:
        self.state = ""

    def turns(self, edits: Iterator[str], rows: list[tuple[str, str]], last: bool) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the repaired turns. ``edits`` is consumed as far as the rows go, to its end with the last of them."""
        rest = iter(rows)
        left = len(rows)
        while left or last:
            letter = next(edits, None)
            if letter is None:
                return
            role, text = ("", "") if letter == "I" else next(rest)
            left -= letter != "I"
            if letter == "D":
                continue
            if letter in "IR":
                role = NAMES["a" if self.state == "u" else "u"]
            self.state = role[:1]
            yield letter, role, text


# -- rows


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with a fifth to a quarter damaged, by a checksum of ``conv_id:turn``: dropped, emptied, without sentence ends, repeated, or given to the user.

    A dropped row stays as a mark of its conversation (``gone``). Null values count as one space.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    copies = F.array_repeat(F.when(kind == 4, "user").otherwise(blank("role")), F.when(kind == 3, 2).otherwise(1))
    return conversations.select("conv_id", "turn", F.explode(copies).alias("role"), text.alias("text"), (kind == 0).alias("gone"))


FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def _prepared(rows: DataFrame) -> DataFrame:
    """Rows with what the search needs, in the shared folder: one number each, a digest of their text, faults that a row shows alone."""
    if "gone" not in rows.columns:
        rows = rows.withColumn("gone", F.lit(False))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    live = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(~F.col("gone"), blank("role")).alias("role"), F.when(~F.col("gone"), blank("text")).alias("text"), "gone",
    )
    end = F.substring(_trimmed(F.col("text")), -1, 1)
    fault = F.when(end == "", "blank").when(~end.isin(".", "!", "?"), "truncated")
    place = [F.monotonically_increasing_id().alias("uid"), F.unhex(F.md5("text")).alias("digest"), F.left("text", F.lit(64)).alias("head"), fault.alias("fault")]
    return written(live.select("*", *place))


def _repeats(rows: DataFrame, total: int) -> DataFrame:
    """The rows whose role and text occur earlier in their conversation, without their texts.

    The first of each group comes from a pre-aggregated count and is joined back. Groups of more
    rows than the larger of ``HOT_ROWS`` and a ``HOT_KEYS``-th of all are at most ``HOT_KEYS``:
    they are broadcast, so that only groups of fewer rows meet in one task.
    """
    key, order = ["conv_id", "role", "digest"], F.struct(F.col("turn").isNotNull().alias("known"), "turn", "uid")
    keys = rows.where("not gone and fault is distinct from 'blank'").select(*key, "turn", "head", "uid", order.alias("at"))
    firsts = written(keys.groupBy(*key).agg(F.count("*").alias("n"), F.min("at").alias("first")).where("n > 1"))
    most = max(HOT_ROWS, total // HOT_KEYS)
    found = []
    for part, hint in ((firsts.where(F.col("n") > most), True), (firsts.where(F.col("n") <= most), False)):
        part = part.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
        on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
        found.append(keys.join(F.broadcast(part) if hint else part, on).where(F.col("at") > F.col("first")).select("conv_id", "turn", "role", "head", "digest", "uid"))
    return found[0].unionByName(found[1])


class _Open:
    """A conversation while its rows arrive in order: what of it isn't sent on yet."""

    def __init__(self, conv: object):
        self.conv, self.sent = conv, 0
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple[str, str]] = []
        self.sign: list[str] = []
        self.size = self.illegal = self.distinct = 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        initial = role[:1]
        if self.rows and self.rows[-1][0][:1] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        if fault:
            self.counts[fault] += 1
        self.rows.append((role, text))
        kind = initial if initial in ("s", "u", "a") else "o"
        self.sign.append("x" if fault in ("blank", "duplicate") else kind.upper() if fault else kind)
        self.size += len(role) + len(text)

    @property
    def full(self) -> bool:
        return len(self.rows) >= PIECE_ROWS or self.size >= PIECE_BYTES

    def facts(self) -> dict[str, object]:
        return {**self.counts, "illegal": self.illegal, "distinct": self.distinct, "low": self.low, "high": self.high, "begins": self.rows[0][0][:1] if self.rows else None, "ends": self.rows[-1][0][:1] if self.rows else None}


def _gaps(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else high - low + 1 - distinct


PART = "part int, seq long, pass int, sign string, blank long, duplicate long, truncated long, illegal long, distinct long, low long, high long, begins string, ends string"
DONE = "gaps long, cost long, audit string, repaired_sha256 string"


def _schema(rows: DataFrame) -> T.StructType:
    ours = T.StructType.fromDDL(f"{PART}, {DONE}")
    return T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *ours.fields, T.StructField("turns", T.ArrayType(TURN))])


def _blank_row(names: list[str], **values: object) -> dict[str, object]:
    return dict.fromkeys(names) | values


def _digest(edits: Iterator[str], rows: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in Repair().turns(edits, rows, True)).encode()).hexdigest()


def _pieces(rows: DataFrame) -> DataFrame:
    """Sorted rows to results and pieces, in one stream a task.

    A conversation that begins and ends inside a task and fits in a piece is searched at once
    (pass -1). The first and the last one of a task may go on in another, and a large one does: of those each
    piece is two rows, its facts (pass 0) and its turns (pass 1).
    """
    schema = _schema(rows)
    names, kinds = schema.names, to_arrow_schema(schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, now, seq, first, marked = TaskContext.get().partitionId(), [], None, 0, True, None

        def send(conv: _Open) -> None:
            nonlocal seq
            own = dict(conv_id=conv.conv, part=part, seq=seq)
            out.append(_blank_row(names, **own, **{"pass": 0}, sign="".join(conv.sign), **conv.facts()))
            out.append(_blank_row(names, **own, **{"pass": 1}, turns=[{"role": r, "text": t} for r, t in conv.rows]))
            seq, conv.sent = seq + 1, conv.sent + 1
            conv.clear()

        def close(conv: _Open, inside: bool) -> None:
            if not inside or conv.sent or conv.full:
                if conv.rows or not conv.sent:
                    send(conv)
                return
            sign = "".join(conv.sign)
            cost, edits = cheapest(sign)
            facts = {**conv.counts, "illegal": conv.illegal, "gaps": _gaps(conv.low, conv.high, conv.distinct), "cost": cost}
            out.append(_blank_row(names, conv_id=conv.conv, **{"pass": -1}, **facts, audit=edits, repaired_sha256=_digest(iter(edits), conv.rows)))

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != now.conv:
                    if now is not None:
                        close(now, not first)
                        first = False
                    now = _Open(row["conv_id"])
                if row["mark"]:
                    marked = row["uid"]
                elif not row["gone"]:
                    if now.full:
                        send(now)
                    now.add(row["turn"], row["role"], row["text"], "duplicate" if row["uid"] == marked else row["fault"])
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out.clear()
        if now is not None:
            close(now, False)
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    return rows.mapInArrow(stream, schema)


def _finished(pieces: DataFrame) -> DataFrame:
    """The conversations that came in several pieces, or that might have. A task gets of each first the facts of all pieces, one
    character a row, finds the edits, then hashes the turns piece by piece as they arrive."""
    schema = T.StructType([pieces.schema["conv_id"], *T.StructType.fromDDL(f"{', '.join(f'{c} long' for c in FACTS)}, audit string, repaired_sha256 string").fields])
    kinds = to_arrow_schema(schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, facts, edits, cost, text, repair, sha, out, any_turn = object(), [], None, 0, "", None, None, [], False

        def solve() -> None:
            nonlocal edits, cost, text, repair, sha, any_turn
            signs = (s for f in facts for s in _segments(f["sign"]))
            cost, parts = cheapest_chain(signs)
            text = "".join(parts)
            edits, repair, sha, any_turn = iter(text), Repair(), hashlib.sha256(), False

        def close() -> None:
            total = {c: sum(f[c] for f in facts) for c in ("blank", "duplicate", "truncated", "illegal", "distinct")}
            low, high, ends = None, None, None
            for f in facts:
                if f["begins"] is not None:
                    total["illegal"] += ends is not None and ends + f["begins"] not in ("su", "ua", "au")
                    ends = f["ends"]
                if f["low"] is not None:
                    total["distinct"] -= f["low"] == high
                    low, high = f["low"] if low is None else low, f["high"]
            gaps = _gaps(low, high, total.pop("distinct"))
            hash_turns([], True)
            out.append({"conv_id": conv, "gaps": gaps, **total, "cost": cost, "audit": text, "repaired_sha256": sha.hexdigest()})

        def hash_turns(rows: list[tuple[str, str]], last: bool) -> None:
            nonlocal any_turn
            for _, role, words in repair.turns(edits, rows, last):
                sha.update(("\n" * any_turn + f"{role}:{words}").encode())
                any_turn = True

        for batch in batches:
            for row in batch.to_pylist():
                if row["conv_id"] != conv:
                    if facts:
                        close()
                    conv, facts, edits = row["conv_id"], [], None
                if row["pass"] == 0:
                    facts.append(row)
                    continue
                if edits is None:
                    solve()
                hash_turns([(t["role"], t["text"]) for t in row["turns"]], False)
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out.clear()
        if facts:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    return pieces.mapInArrow(stream, schema)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``rows(conv_id, turn, role, text)``: its faults, the cheapest edits (audit), their cost, and the digest of the repaired turns.

    Turns are ordered by (turn, role, first 64 characters of the text, its MD5), nulls first. A row's first fault
    counts: blank, duplicate (role and text occur earlier), truncated (no sentence end). ``gaps`` is the number of missing turns and
    ``illegal`` that of neighbours that may not follow each other. Edits: Keep (0), Rerole (3), Delete (4, all that
    blank and repeated rows allow), Insert an empty turn (3); truncated rows that stay cost 3. Roles
    count by their initials: an optional system turn, then user and assistant in turn.

    A conversation is searched by iterative-deepening A* in segments of ``SEGMENT`` rows; one of more
    rows is joined from its segments' answers for each pair of states at their ends. Rows are sorted
    by range, so a large conversation is dealt to many tasks; its last task gets one row for each
    1,024 turns or MB, and its digest needs the texts in order, but never more than a piece at once.

    Nulls in role and text count as one space, and a null conv_id is a conversation. Empty texts are blank; long
    ones are carried whole. Repeated rows are duplicates. A column ``gone`` marks rows that only name their conversation: one
    without other rows has zeros, an empty audit and the digest of nothing. Other columns are not read. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    known = _prepared(rows)
    total, size = known.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()
    marks = _repeats(known, total)
    own = known.select("conv_id", "turn", "role", "head", "digest", "uid", F.lit(0).alias("mark"), "text", "fault", "gone")
    other = marks.select("conv_id", "turn", "role", "head", "digest", "uid", F.lit(1).alias("mark"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("fault"), F.lit(False).alias("gone"))
    by = ["conv_id", "turn", "role", "head", "digest", "uid"]
    dealt = own.unionByName(other).repartitionByRange(part_count(known, size or 0), *by).sortWithinPartitions(*by, F.desc("mark"))
    pieces = written(_pieces(dealt.select("conv_id", "turn", "role", "text", "fault", "uid", "gone", (F.col("mark") == 1).alias("mark"))))
    made = ["conv_id", *FACTS, "audit", "repaired_sha256"]
    rest = pieces.where("pass >= 0").drop("gaps", "cost", "audit", "repaired_sha256").repartition("conv_id").sortWithinPartitions("conv_id", "pass", "part", "seq")
    return pieces.where("pass < 0").select(made).unionByName(_finished(rest).select(made))
