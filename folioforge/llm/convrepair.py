"""Least-cost repair of conversations by layers of reachable grammar states.

The role initials of a conversation have to read ``(s?(ua)+)?``, four states.
Layer c holds, for every turn, the set of states (four bits) from which the
end is reached at a cost of exactly c; it follows from the layers below it and
from itself one turn further on, so the layers are built one after the other
until the first one that holds the start, whose number is the cost.  Going
forward through the bits with the first letter that stays in them gives the
least audit.  All conversations of a batch go through the layers together.

Rows that have to go (blank, repeated) cost the same in every repair and stay
out of the layers.  A conversation is cut into pieces of PIECE turns at most,
wherever its sorted rows lie; a piece is summed up by the least cost from each
state to each, which are folded from the end to tell every piece what the rest
costs from each state.  So no task holds a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, parallelism, partition_id, tune, written

#: Turns and characters of one piece, and conversations and characters that are repaired together.
PIECE, PIECE_CHARS = 64, 1 << 20
TOGETHER, TOGETHER_CHARS = 1024, 8 << 20

DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
#: States: at the start, after the system turn, after a user's, after an assistant's.  The start and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What reaching an accepted end by insertions costs from each state.
END = (0, 2 * INSERT, INSERT, 0)
#: Row classes: role initial s, u, a, or another; PAD stands for no row.
S, U, A, OTHER, PAD = range(5)
_ON = {(START, S): SYSTEM, (START, U): USER, (SYSTEM, U): USER, (USER, A): ASSISTANT, (ASSISTANT, U): USER}
#: The state after an inserted or reroled turn: user and assistant in turn.
_NEXT = np.array([USER, USER, ASSISTANT, USER])
_KEEP = np.array([[_ON.get((s, x), -1) for s in range(4)] for x in (S, U, A, OTHER)])
_LETTER = np.frombuffer(b"DIKR", np.uint8)
_NONE = -1


def _before(on) -> np.ndarray:
    """For every set of states: the states from which ``on`` leads into it."""
    return np.array([sum(1 << s for s in range(4) if on[s] >= 0 and bits >> on[s] & 1) for bits in range(16)], np.uint8)


_BEFORE_NEXT = _before(_NEXT)
_BEFORE_KEEP = np.stack([*map(_before, _KEEP), np.arange(16, dtype=np.uint8)])  # PAD leads nowhere else


def cost_layers(kind: np.ndarray, cut: np.ndarray, end: np.ndarray, wanted: int) -> np.ndarray:
    """layers[c, i, b]: the states of conversation b from which rows i and on, then the end, cost exactly c.

    ``kind`` and ``cut`` are rows by conversations, ``end`` is the cost from
    each state after the last row (negative: no end).  Stops once every
    conversation has all states of ``wanted`` in its first row, or where no
    more can come.
    """
    n, b = kind.shape
    real = kind != PAD
    keep_free = np.where(cut, OTHER, kind) * 16  # a cut row is never kept for nothing
    keep_cut = np.where(cut, kind, OTHER) * 16
    table = _BEFORE_KEEP.reshape(-1)
    most = DELETE * n + 4 * INSERT + int(end.max(initial=0))
    layers: list[np.ndarray] = []
    seen = np.zeros(b, np.uint8)
    for c in range(most + 1):
        at = lambda k: layers[c - k]  # noqa: B023, E731
        here = np.zeros((n + 1, b), np.uint8)
        here[n] = ((end == c) << np.arange(4)).sum(axis=1)
        if c >= REROLE:
            here[:n] |= np.where(real & ~cut, _BEFORE_NEXT[at(REROLE)[1:]], 0)
        if c >= DELETE:
            here[:n] |= np.where(real, at(DELETE)[1:], 0)
        if c >= CUT:
            here[:n] |= np.where(cut, table[keep_cut + at(CUT)[1:]], 0)
        if c >= INSERT:
            here[:n] |= np.where(real, _BEFORE_NEXT[at(INSERT)[:-1]], 0)
        if c >= CUT + REROLE:
            here[:n] |= np.where(cut, _BEFORE_NEXT[at(CUT + REROLE)[1:]], 0)
        for i in range(n - 1, -1, -1):
            here[i] |= table[keep_free[i] + here[i + 1]]
        layers.append(here)
        seen |= here[0]
        if ((seen & wanted) == wanted).all():
            break
    return np.stack(layers)


def _least(layers: np.ndarray, state: int) -> np.ndarray:
    """The first layer that holds ``state`` at the first row, or -1."""
    has = (layers[:, 0] >> state & 1).astype(bool)
    return np.where(has.any(axis=0), has.argmax(axis=0), _NONE)


def least_audits(layers: np.ndarray, kind: np.ndarray, cut: np.ndarray, state: int):
    """(cost, audit bytes, state after the last row) of every conversation from ``state``; cost -1 where there is none."""
    n, b = kind.shape
    cost = _least(layers, state)
    c, s, i = cost.copy(), np.full(b, state), np.zeros(b, np.int64)
    length = (kind != PAD).sum(axis=0)
    every, letters = np.arange(b), []

    def holds(k: np.ndarray, row: np.ndarray, to: np.ndarray) -> np.ndarray:
        ok = (k >= 0) & (to >= 0)
        return ok & (layers[np.where(ok, k, 0), row, every] >> np.maximum(to, 0) & 1).astype(bool)

    while True:
        live = (i < length) & (cost >= 0)
        if not live.any():
            break
        row = np.minimum(i, n - 1)
        x, more = kind[row, every], CUT * cut[row, every]
        nxt, kept = _NEXT[s], _KEEP[np.minimum(x, OTHER), s]
        after = np.minimum(i + 1, n)
        choice = np.stack([holds(c - DELETE, after, s), holds(c - INSERT, row, nxt), holds(c - more, after, kept), holds(c - more - REROLE, after, nxt)]).argmax(axis=0)
        letters.append(np.where(live, _LETTER[choice], 0))
        paid = np.choose(choice, [DELETE, INSERT, more, more + REROLE])
        to = np.choose(choice, [s, nxt, kept, nxt])
        c, s, i = np.where(live, c - paid, c), np.where(live, to, s), np.where(live & (choice != 1), i + 1, i)
    audits = np.array(letters, np.uint8).T if letters else np.zeros((b, 0), np.uint8)
    return cost, [a.tobytes().replace(b"\0", b"") for a in audits], s


def _padded(pieces: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(places, kinds, cuts) of pieces of like length; a byte is 2 * class + cut."""
    length = np.array([len(p) for p in pieces])
    width = np.left_shift(2, np.ceil(np.log2(np.maximum(length, 2))).astype(int) - 1)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w).tolist()
        flat = np.frombuffer(b"".join(pieces[k].ljust(w, bytes([2 * PAD])) for k in at), np.uint8).reshape(len(at), w).T.astype(np.int64)
        yield at, flat >> 1, (flat & 1).astype(bool)


def piece_costs(pieces: list[bytes]) -> list[list[int]]:
    """The least cost from each state to each (16 numbers, -1: none) of every piece."""
    out: list[list[int]] = [[_NONE] * 16 for _ in pieces]
    for at, kind, cut in _padded(pieces):
        for to in range(4):
            end = np.full((len(at), 4), _NONE)
            end[:, to] = 0
            layers = cost_layers(kind, cut, end, 15)
            for s in range(4):
                for k, c in zip(at, _least(layers, s).tolist()):
                    out[k][4 * s + to] = c
    return out


def piece_repairs(pieces: list[bytes], ends: list[list[int]], states: tuple[int, ...]):
    """For each piece and each state of ``states``: (cost of the piece and the rest, audit, state after it)."""
    out: list[list] = [[None] * len(states) for _ in pieces]
    for at, kind, cut in _padded(pieces):
        layers = cost_layers(kind, cut, np.array([ends[k] for k in at]), sum(1 << s for s in states))
        for j, s in enumerate(states):
            cost, audit, to = least_audits(layers, kind, cut, s)
            for k, found in zip(at, zip(cost.tolist(), audit, to.tolist())):
                out[k][j] = found
    return out


class Repaired:
    """Cost, audit and hash of a repaired conversation, a piece at a time."""

    def __init__(self):
        self.state, self.cost, self.audit, self.digest, self.first = START, 0, [], hashlib.sha256(), True

    def _turn(self, role: str, text: str) -> None:
        self.digest.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
        self.first = False

    def _new_role(self) -> str:
        self.state = int(_NEXT[self.state])
        return "user" if self.state == USER else "assistant"

    def _insert(self) -> None:
        self.cost += INSERT
        self.audit.append("I")
        self._turn(self._new_role(), "")

    def _delete(self, n: int) -> None:
        self.cost += DELETE * n
        self.audit.append("D" * n)

    def add(self, edits: bytes, rows: bytes, roles: list[str], texts: list[str], forced: list[int]) -> None:
        """``forced`` rows to delete stand before each row and after the last; their letters come before insertions."""
        row, fresh = 0, True
        for letter in edits.decode():
            if fresh:
                self._delete(forced[row])
            fresh = letter != "I"
            if letter == "I":
                self._insert()
                continue
            if letter == "D":
                self._delete(1)
            else:
                self.audit.append(letter)
                self.cost += CUT * (rows[row] & 1) + REROLE * (letter == "R")
                if letter == "K":
                    self.state = int(_KEEP[rows[row] >> 1][self.state])
                self._turn(roles[row] if letter == "K" else self._new_role(), texts[row])
            row += 1
        self._delete(forced[row])

    def end(self) -> tuple[int, str, str]:
        while self.state in (SYSTEM, USER):
            self._insert()
        return self.cost, "".join(self.audit), self.digest.hexdigest()


def _class(role: str) -> int:
    return {"s": S, "u": U, "a": A}.get(role[:1], OTHER)


_LEGAL = {(S, U), (U, A), (A, U)}

_PIECE = (
    "whole boolean, conv {conv}, part int, seq int, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, "
    "first_class int, last_class int, cost long, audit string, repaired_sha256 string, rows binary, costs array<long>, roles array<string>, texts array<string>, forced array<long>"
)


class _Piece:
    """Rows of one conversation that follow each other."""

    __slots__ = ("conv", "seq", "goes_on", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first_class", "last_class", "rows", "roles", "texts", "forced", "chars")

    def __init__(self, conv, seq: int, goes_on: bool = False):
        self.conv, self.seq, self.goes_on = conv, seq, goes_on
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.chars = 0
        self.first_turn = self.last_turn = self.first_class = self.last_class = None
        self.rows, self.roles, self.texts, self.forced = bytearray(), [], [], [0]

    def full(self) -> bool:
        return len(self.rows) >= PIECE or self.chars >= PIECE_CHARS

    def summary(self, part: int) -> tuple:
        return self.conv, part, self.seq, self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.first_turn, self.last_turn, self.first_class, self.last_class

    def add(self, turn, role: str, text: str, n: int, first: bool, blank: bool, cut: bool) -> None:
        kind = _class(role)
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        if self.first_class is None:
            self.first_class = kind
        elif (self.last_class, kind) not in _LEGAL:
            self.illegal += 1
        self.last_class = kind
        self.illegal += n - 1
        if blank:
            self.blank += n
            self.forced[-1] += n
            return
        if not first:
            self.duplicate += n
            self.forced[-1] += n
            return
        self.duplicate += n - 1
        self.truncated += cut
        self.rows.append(2 * kind + cut)
        self.roles.append(role)
        self.texts.append(text)
        self.forced.append(n - 1)
        self.chars += len(role) + len(text)


def _gaps(first, last, turns: int) -> int:
    """Missing turns, as 64-bit arithmetic has it."""
    if first is None:
        return 0
    return (last - first + 1 - turns + (1 << 63)) % (1 << 64) - (1 << 63)


_ARROW = {
    "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
}


def _batch(rows: list[tuple], ddl: str, conv: pa.DataType) -> pa.RecordBatch:
    """A batch of the schema ``ddl``; the type of ids is that of the input."""
    names, kinds = zip(*(f.split(" ", 1) for f in ddl.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, conv if n == "conv" else _ARROW[k]) for c, n, k in zip(zip(*rows), names, kinds)], names)


def _pieces_of(stream: DataFrame, conv_type: str) -> DataFrame:
    """Solved conversations that lie whole in one task and fit one piece, and the pieces of all others."""
    ddl = _PIECE.format(conv=conv_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = partition_id()

        def solved(waiting: list[_Piece]) -> pa.RecordBatch:
            out = []
            found = piece_repairs([bytes(p.rows) for p in waiting], [list(END)] * len(waiting), (START,))
            for p, ((_, edits, _),) in zip(waiting, found):
                r = Repaired()
                r.add(edits, p.rows, p.roles, p.texts, p.forced)
                out.append((True, *p.summary(part), *r.end(), None, None, None, None, None))
            return _batch(out, ddl, id_type)

        def opened(waiting: list[_Piece]) -> pa.RecordBatch:
            out = []
            for p, costs in zip(waiting, piece_costs([bytes(p.rows) for p in waiting])):
                out.append((False, *p.summary(part), None, None, None, bytes(p.rows), costs, p.roles, p.texts, p.forced))
            return _batch(out, ddl, id_type)

        now: _Piece | None = None
        edge = True  # the first conversation may have begun in another task
        marked, number = None, count()
        id_type = pa.null()
        whole: list[_Piece] = []
        open_: list[_Piece] = []
        for batch in batches:
            id_type = batch.schema.field("conv").type
            columns = (batch.column(k).to_pylist() for k in range(batch.num_columns))
            for conv, turn, role, h1, h2, row, n, text, blank, cut in zip(*columns):
                if now is None or conv != now.conv:
                    if now is not None:
                        (open_ if edge or now.goes_on else whole).append(now)
                        edge = False
                    now, marked = _Piece(conv, next(number)), None
                if role is None:
                    continue
                if not row:
                    marked = (turn, role, h1, h2)
                    continue
                if now.full():
                    open_.append(now)
                    now = _Piece(conv, next(number), True)
                now.add(turn, role, text, n, marked == (turn, role, h1, h2), blank, cut)
            for waiting, f in ((whole, solved), (open_, opened)):
                while waiting and (len(waiting) >= TOGETHER or sum(p.chars for p in waiting) >= TOGETHER_CHARS):
                    yield f(waiting[:TOGETHER])
                    del waiting[:TOGETHER]
        if now is not None:
            open_.append(now)  # it may go on in another task
        for waiting, f in ((whole, solved), (open_, opened)):
            for a in range(0, len(waiting), TOGETHER):
                yield f(waiting[a : a + TOGETHER])

    return map_arrow(stream, run, ddl)


def _ends(pieces: DataFrame) -> DataFrame:
    """(part, seq, end): what the rest of its conversation costs from each state after a piece, less the least of them."""
    backwards = pieces.select("conv", "part", "seq", "costs").repartition(parallelism(pieces.sparkSession), "conv")
    backwards = backwards.sortWithinPartitions("conv", F.desc("part"), F.desc("seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, rest, begun = None, None, False
        for batch in batches:
            out = []
            for c, part, seq, costs in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if not begun or c != conv:
                    conv, rest, begun = c, list(END), True
                least = min(rest)
                rest = [r - least for r in rest]
                out.append((part, seq, rest))
                rest = [min((costs[4 * s + to] + rest[to] for to in range(4) if costs[4 * s + to] >= 0)) for s in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.list_(pa.int64()))], ["part", "seq", "end"])

    return map_arrow(backwards, run, "part int, seq int, end array<long>")


_RESULT = "conv {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _joined(pieces: DataFrame, conv_type: str) -> DataFrame:
    """The results of conversations in several pieces, or at the edge of a task."""
    carried = ["conv", "part", "seq", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first_class", "last_class", "rows", "roles", "texts", "forced"]
    full = pieces.select(*carried).join(_ends(pieces).hint("merge"), ["part", "seq"]).select(*carried, "end")
    kinds = dict(f.split(" ", 1) for f in _PIECE.format(conv=conv_type).split(", "))
    ddl = ", ".join(f"{c} {kinds[c]}" for c in carried) + ", edits array<binary>, to array<int>"

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                b = batch.slice(a, TOGETHER)
                found = piece_repairs(b.column(carried.index("rows")).to_pylist(), b.column(len(carried)).to_pylist(), (START, SYSTEM, USER, ASSISTANT))
                edits = pa.array([[x[1] for x in f] for f in found], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(carried)], edits, pa.array([[x[2] for x in f] for f in found], pa.list_(pa.int32()))], [*carried, "edits", "to"])

    traced = map_arrow(full, trace, ddl).repartition(parallelism(pieces.sparkSession), "conv").sortWithinPartitions("conv", "part", "seq")
    out_ddl = _RESULT.format(conv=conv_type)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, id_type = None, [], pa.null()

        def end():
            done.append((now["conv"], _gaps(now["first_turn"], now["last_turn"], now["turns"]), *(now[c] for c in ("blank", "duplicate", "truncated", "illegal")), *now["repaired"].end()))

        for batch in batches:
            id_type = batch.schema.field("conv").type
            for values in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                p = dict(zip([*carried, "edits", "to"], values))
                if now is None or p["conv"] != now["conv"]:
                    if now is not None:
                        end()
                    now = p | {"repaired": Repaired()}
                else:
                    for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                        now[c] += p[c]
                    if p["first_turn"] is not None:
                        now["turns"] -= p["first_turn"] == now["last_turn"]
                        now["first_turn"] = p["first_turn"] if now["first_turn"] is None else now["first_turn"]
                        now["last_turn"] = p["last_turn"]
                    if p["first_class"] is not None:
                        now["illegal"] += now["last_class"] is not None and (now["last_class"], p["first_class"]) not in _LEGAL
                        now["last_class"] = p["last_class"]
                repaired = now["repaired"]
                repaired.add(p["edits"][repaired.state], p["rows"], p["roles"], p["texts"], p["forced"])
            if done:
                yield _batch(done, out_ddl, id_type)
                done.clear()
        if now is not None:
            end()
            yield _batch(done, out_ddl, id_type)

    return map_arrow(traced, fold, out_ddl)


#: The characters that count as blank, and those that end a text.
BLANKS, STOPS = "\x20\x09\x0a\x0b\x0c\x0d", ".!?"


def repair_conversations(
    df: DataFrame, copies: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Faults and least-cost repair of every conversation.

    A row's first fault counts: blank (nothing but ASCII blanks), duplicate
    (role and text of an earlier row), truncated (no ``.!?`` at the end).
    Keeping a row costs 0, giving it the role user or assistant 1, deleting it
    2 (blank and duplicate rows have to go), inserting an empty user or
    assistant turn 5; a truncated row that stays costs 5 more.  The repaired
    role initials read ``(s?(ua)+)?``.  Returns one row per conversation:
    (conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256); the audit is the ASCII-least of the cheapest ones.

    Rows stand by turn, nulls first; rows of one turn by role, then by two
    hashes of role and text.  Null roles and texts are one space.  A row
    stands ``copies`` times (once by default); with none it only names its
    conversation, and a conversation without rows has zeros, an empty audit
    and the hash of nothing.  Repeated rows are duplicates; rows of a null id
    are one conversation; an empty table stays empty; other columns are not
    read, whatever their names.

    The hash of a conversation has no parallel form: its turns, a piece of 64
    a row, pass one task in order, which holds one piece and the audit.
    """
    tune(df.sparkSession)
    conv_type = df.schema[conv_col].dataType.simpleString()
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    n = F.coalesce((copies if copies is not None else F.lit(1)).cast("long"), F.lit(0))
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), n.alias("n"))
    stands = F.col("n") > 0
    rows = rows.select("conv", *(F.when(stands, F.col(c)).alias(c) for c in ("turn", "role", "text")), "n")
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    rows = rows.select("conv", "turn", "role", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"), F.lit(1).alias("row"), "n", "text")
    firsts = rows.where(F.col("role").isNotNull()).groupBy("conv", "role", "h1", "h2").agg(F.min(F.struct("turn"))["turn"].alias("turn"))
    marks = firsts.select("conv", "turn", "role", "h1", "h2", F.lit(0).alias("row"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("text"))
    bare = F.rtrim("text", F.lit(BLANKS))
    stream = rows.unionByName(marks).withColumns({
        "blank": F.coalesce(bare == "", F.lit(False)),
        "cut": F.coalesce(~F.substring(bare, -1, 1).isin(*STOPS), F.lit(False)),
    })
    order = ["conv", "turn", "role", "h1", "h2"]
    stream = stream.repartitionByRange(parallelism(df.sparkSession), *order).sortWithinPartitions(*order, "row")
    pieces = written(_pieces_of(stream.select(*order, "row", "n", "text", "blank", "cut"), conv_type), "conversation-pieces")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    solved = pieces.where("whole").select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return solved.unionByName(_joined(pieces.where("not whole"), conv_type)).withColumnRenamed("conv", conv_col)
