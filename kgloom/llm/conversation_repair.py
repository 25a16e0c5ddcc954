"""Conversation structure repair (11): a forward Viterbi search per conversation.

The wanted grammar of roles, `(s?(ua)+)?`, has four states: nothing yet, after
the system row, after a user row, after an assistant row. For each state the
search carries the minimum (cost, audit string) of the edits that lead there. A
row's layer is closed by at most two insertions, which is all that can pay: a
third one would lead back to a state that was cheaper. The letters of an audit
and the rows fix what is kept, so that its ties are ties of letters alone.

Rows are sorted in ranges of (conversation, turn, role, text), which cut a long
conversation into pieces. A piece yields, for each state that it may be entered
in, the minimum that it is left with in each state; pieces are then chained like
matrices. Where all survivors begin alike, that beginning is settled and put by,
so a task holds short strings however long the conversation is. Equal rows are
counted before the sort. Only the SHA-256 of a conversation cut by a range is
left to one task, as that hash cannot be taken in parts: it streams the sorted
rows once more and holds one at a time.

Defined cases: a null role, text or turn in a key counts as one space, a null
turn sorts first, a null conv_id is a conversation of its own; rows of one turn
are ordered by role and text; a conversation that has lost all its rows keeps a
row of zeros; an empty table gives none; a row whose role has another initial can
be deleted or given a new role, not kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import hinted, lean, materialize

#: States: nothing yet, after s, after u, after a. A conversation may end in the first or the last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: State after a kept row, by its role's initial and the state before.
KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: State after a row that is put in or given a new role, by the state before; and the role that it has then.
MADE = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Insertions that close a layer.
MOST_INSERTED = 2
LEGAL = ("su", "ua", "au")
#: Letters of an audit that are carried before their common beginning is put by.
_CARRIED = 256

_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


class Paths:
    """The minima from one state on: by state a (cost, letters, hash of the lines so far), and the letters that all of them share."""

    def __init__(self, state: int, hashed: bool) -> None:
        self.layer: dict[int, tuple[int, str, object]] = {state: (0, "", hashlib.sha256() if hashed else None)}
        self.shared: list[str] = []

    @staticmethod
    def _hashed(path: tuple, state_before: int, line: bytes | None) -> object:
        """The hash of a path, one line on."""
        if path[2] is None or line is None:
            return path[2]
        h = path[2].copy()
        h.update(line if state_before == NOTHING else b"\n" + line)
        return h

    def _best(self, found: list[tuple[int, str, int, int, tuple, bytes | None]]) -> dict[int, tuple[int, str, object]]:
        """By state the least (cost, letters) of (cost, letters, state, state before, path before, line)."""
        best: dict[int, tuple] = {}
        for c in found:
            if c[2] not in best or c[:2] < best[c[2]][:2]:
                best[c[2]] = c
        return {s: (c[0], c[1], self._hashed(c[4], c[3], c[5])) for s, c in best.items()}

    def closed(self) -> dict[int, tuple[int, str, object]]:
        """The layer with insertions; it is closed when the next edit follows, as deletions come before insertions of equal cost."""
        layer = self.layer
        for _ in range(MOST_INSERTED):
            made = {s: (p[0] + INSERT, p[1] + "I") for s, p in layer.items()}
            if not any(MADE[s] not in layer or m < layer[MADE[s]][:2] for s, m in made.items()):
                break
            stay = [(p[0], p[1], s, s, p, None) for s, p in layer.items()]
            layer = self._best(stay + [(*m, MADE[s], s, layer[s], f"{ROLES[MADE[s]]}:".encode()) for s, m in made.items()])
        return layer

    def delete(self, rows: int) -> None:
        """Rows that must go: blank ones and repeats."""
        self.layer = {s: (c + DELETE * rows, w + "D" * rows, h) for s, (c, w, h) in self.layer.items()}
        self._settle()

    def edit(self, role: str, truncated: bool, text: str) -> None:
        """A row that may be kept, given another role, or deleted."""
        extra, found = TRUNCATED * truncated, []
        kept = KEPT.get(role[:1], {})
        for s, path in self.closed().items():
            cost, letters, _ = path
            found.append((cost + DELETE, letters + "D", s, s, path, None))
            if s in kept:
                found.append((cost + extra, letters + "K", kept[s], s, path, f"{role}:{text}".encode()))
            found.append((cost + REROLE + extra, letters + "R", MADE[s], s, path, f"{ROLES[MADE[s]]}:{text}".encode()))
        self.layer = self._best(found)
        # From ASSISTANT all is open that is open from SYSTEM, and from NOTHING too once a system row, if any, is deleted.
        if ASSISTANT in self.layer:
            best = self.layer[ASSISTANT][0]
            for s, more in ((NOTHING, DELETE), (SYSTEM, 0)):
                if s in self.layer and self.layer[s][0] > best + more:
                    del self.layer[s]
        self._settle()

    def _settle(self) -> None:
        letters = [p[1] for p in self.layer.values()]
        if len(letters[0]) >= _CARRIED and (n := len(os.path.commonprefix(letters))) > _CARRIED // 2:
            self.shared.append(letters[0][:n])
            self.layer = {s: (c, w[n:], h) for s, (c, w, h) in self.layer.items()}

    def ends(self) -> dict[int, tuple[int, str]]:
        """By state the minimum before closing insertions."""
        begun = "".join(self.shared)
        return {s: (c, begun + w) for s, (c, w, _) in self.layer.items()}

    def finish(self) -> tuple[int, str, str | None]:
        """(cost, audit, hash of the repaired lines) of the whole."""
        cost, letters, h = min((p for s, p in self.closed().items() if s in (NOTHING, ASSISTANT)), key=lambda p: p[:2])
        return cost, "".join(self.shared) + letters, h and h.hexdigest()


_COUNTS = ("rows", "turns", "blank", "duplicate", "truncated", "illegal")
_PIECE = "conv_id bigint, part int, rows bigint, turns bigint, least bigint, most bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, cost bigint, audit string, sha string, paths array<struct<entry:int,leave:int,cost:bigint,letters:string>>"
_STRUCT = pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())]))
_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), *((c, pa.int64()) for c in ("rows", "turns", "least", "most", "blank", "duplicate", "truncated", "illegal")), ("head", pa.string()), ("tail", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("sha", pa.string()), ("paths", _STRUCT)])


class _Piece:
    """A conversation, or what one range has of it."""

    def __init__(self, conv_id: int | None, entries: int) -> None:
        self.conv_id = conv_id
        self.paths = [Paths(s, hashed=s == NOTHING) for s in range(entries)]
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.least = self.most = self.head = self.tail = None

    def add(self, row: tuple) -> None:
        """Take `n` equal rows; the first of them is `fault`, the others are repeats of it."""
        turn, role, text, n, fault = row
        if not n:  # a mark that the conversation has had rows
            return
        had, initial = self.counts, role[:1]
        had["rows"] += n
        if turn is not None and turn != self.most:
            had["turns"] += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        had["illegal"] += (self.tail is not None and self.tail + initial not in LEGAL) + (n - 1) * (2 * initial not in LEGAL)
        self.head, self.tail = initial if self.head is None else self.head, initial
        if fault in ("blank", "duplicate"):
            had[fault] += n
        else:
            had["truncated"] += fault == "truncated"
            had["duplicate"] += n - 1
        free = fault not in ("blank", "duplicate")
        for p in self.paths:
            if free:
                p.edit(role, fault == "truncated", text)
            if n - free:
                p.delete(n - free)

    def row(self, part: int, whole: bool) -> dict:
        cost, audit, sha = self.paths[NOTHING].finish()
        paths = None if whole else [{"entry": i, "leave": s, "cost": c, "letters": w} for i, p in enumerate(self.paths) for s, (c, w) in p.ends().items()]
        return {"conv_id": self.conv_id, "part": part, **self.counts, "least": self.least, "most": self.most, "head": self.head, "tail": self.tail, "cost": cost, "audit": audit, "sha": sha, "paths": paths}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations of a sorted range, and the open ones: the first, which may have begun in an earlier range, and the last."""
    part, piece, first, done, size = TaskContext.get().partitionId(), None, True, [], 0
    for batch in batches:
        columns = [batch.column(c) for c in ("conv_id", "turn", "role", "text", "n", "fault")]
        for k in range(0, batch.num_rows, 256):
            for conv_id, *row in zip(*(c.slice(k, 256).to_pylist() for c in columns), strict=True):
                if piece is None or conv_id != piece.conv_id:
                    if piece is not None:
                        done.append(piece.row(part, whole=not first))
                        size += piece.counts["rows"]
                        first = False
                    piece = _Piece(conv_id, 4 if first else 1)
                piece.add(row)
            if size > 1 << 16:
                yield pa.RecordBatch.from_pylist(done, schema=_ARROW)
                done, size = [], 0
    if piece is not None:
        done.append(piece.row(part, whole=False))
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=_ARROW)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each conversation from the pieces of it, which come in order; that of several pieces has no hash yet."""

    def closed(total: dict, chain: Paths) -> pa.RecordBatch:
        total["cost"], total["audit"], _ = chain.finish()
        return pa.RecordBatch.from_pylist([total | {"paths": None}], schema=_ARROW)

    total, chain = None, None
    for batch in batches:
        for k in range(batch.num_rows):
            piece = batch.slice(k, 1).to_pylist()[0]
            if total is None or piece["conv_id"] != total["conv_id"]:
                if total is not None:
                    yield closed(total, chain)
                total, chain = dict(piece), Paths(NOTHING, hashed=False)
            else:
                for c in _COUNTS:
                    total[c] += piece[c]
                total["turns"] -= piece["least"] is not None and piece["least"] == total["most"]
                total["least"] = piece["least"] if total["least"] is None else total["least"]
                total["most"] = total["most"] if piece["most"] is None else piece["most"]
                if piece["rows"]:
                    total["illegal"] += total["tail"] is not None and total["tail"] + piece["head"] not in LEGAL
                    total["head"], total["tail"] = piece["head"] if total["head"] is None else total["head"], piece["tail"]
                total["sha"] = None
            steps = {}
            for p in piece["paths"]:
                if p["entry"] in chain.layer:
                    cost, letters, _ = chain.layer[p["entry"]]
                    steps.setdefault(p["leave"], []).append((cost + p["cost"], letters + p["letters"], None))
            chain.layer = {s: min(x, key=lambda c: c[:2]) for s, x in steps.items()}
            chain._settle()
    if total is not None:
        yield closed(total, chain)


def _rehashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, sha) of cut conversations, from their rows in order and the audit that comes first."""

    def inserted(h, letters: str, at: int, state: int) -> tuple[int, int]:
        while letters[at : at + 1] == "I":
            line, before, state, at = f"{ROLES[MADE[state]]}:".encode(), state, MADE[state], at + 1
            h.update(line if before == NOTHING else b"\n" + line)
        return at, state

    now = None
    schema = pa.schema([("conv_id", pa.int64()), ("sha", pa.string())])
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            out = []
            for conv_id, audit, role, text, n in zip(*(batch.column(c).slice(k, 256).to_pylist() for c in ("conv_id", "audit", "role", "text", "n")), strict=True):
                if audit is not None:  # the row that leads a conversation
                    if now:
                        inserted(now[1], now[2], now[3], now[4])
                        out.append({"conv_id": now[0], "sha": now[1].hexdigest()})
                    now = [conv_id, hashlib.sha256(), audit, 0, NOTHING]
                    continue
                if not n:
                    continue
                _, h, letters, at, state = now
                at, state = inserted(h, letters, at, state)
                if letters[at] != "D":
                    to = KEPT[role[:1]][state] if letters[at] == "K" else MADE[state]
                    line = f"{role if letters[at] == 'K' else ROLES[to]}:{text}".encode()
                    h.update(line if state == NOTHING else b"\n" + line)
                    state = to
                now[3:] = [at + n, state]  # repeats are deleted
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
    if now:
        inserted(now[1], now[2], now[3], now[4])
        yield pa.RecordBatch.from_pylist([{"conv_id": now[0], "sha": now[1].hexdigest()}], schema=schema)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone of `rows`, damaged by crc32 of `conv_id:turn` modulo 20: 0 is gone, 1 loses its text, 2 its `[.!?]`, 3 comes twice, 4 is a user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(kind == 4, "user").otherwise(blank("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return out.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", "gone", "times")


def _faults(rows: DataFrame) -> DataFrame:
    """Distinct rows with n, how many there are (0 of those that are gone), and the fault of the first of them."""
    key = ["conv_id", "turn", "role", "text"]
    shown = rows.select("conv_id", *(F.when(~F.col("gone"), F.col(c)).alias(c) for c in key[1:]), F.when(F.col("gone"), 0).otherwise(F.col("times")).alias("n"))
    counted = materialize(shown.groupBy(*key).agg(F.sum("n").alias("n")), "rows")
    digest = F.sha2(F.concat_ws(":", "role", "text").cast("binary"), 256)
    # Among a conversation's equal rows of several turns only the first is no repeat.
    seen = counted.filter("n > 0").groupBy("conv_id", digest.alias("digest"), "role").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("c")).filter("c > 1")
    seen = hinted(materialize(seen.select(F.col("conv_id").alias("of"), "digest", F.col("role").alias("by"), "first"), "repeats"))
    joined = counted.join(seen, F.col("of").eqNullSafe(F.col("conv_id")) & (F.col("digest") == digest) & (F.col("by") == F.col("role")), "left")
    last = F.substring(F.rtrim(F.col("text"), F.lit(_SPACE)), -1, 1)
    repeat = F.col("first").isNotNull() & ~F.col("first")["turn"].eqNullSafe(F.col("turn"))
    fault = F.when(last == "", "blank").when(repeat, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return joined.select(*key, "n", fault.alias("fault"))


def _in_order(rows: DataFrame, *first: Column) -> DataFrame:
    """`rows` in ranges, each sorted; a range ends between different beginnings of texts only, as a range's bounds go to the driver."""
    return rows.repartitionByRange(*first, "conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*first, "conv_id", "turn", "role", "text")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of `rows` (conv_id, turn, role, text, gone, times), as `damaged` makes them."""
    counted = materialize(_faults(rows), "faults")
    pieces = materialize(_in_order(counted).mapInArrow(lean(_pieces), _PIECE), "pieces")
    cut = pieces.filter("paths IS NOT NULL").repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(lean(_chained), _PIECE)
    open_ones = materialize(cut, "open")
    whole, again = open_ones.filter("sha IS NOT NULL"), open_ones.filter("sha IS NULL")
    named = hinted(again.select(F.col("conv_id").alias("of")))
    lines = counted.join(named, F.col("of").eqNullSafe(F.col("conv_id")), "left_semi").select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "n")
    heads = again.select("conv_id", "audit", F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("bigint").alias("n"))
    dealt = lines.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "text")
    hashes = dealt.select("conv_id", "audit", "role", "text", "n").mapInArrow(lean(_rehashed), "conv_id bigint, sha string").select(F.col("conv_id").alias("of"), F.col("sha").alias("hash"))
    finished = whole.unionByName(again.join(hashes, F.col("of").eqNullSafe(F.col("conv_id"))).withColumn("sha", F.col("hash")).select(pieces.columns))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0))
    return pieces.filter("paths IS NULL").unionByName(finished).select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))
