"""Repair of conversation structure by Four-Russians block tables.

A conversation is a sequence of symbols: the initial of a row's role, whether its text is cut short, or that the row has to
go. The cheapest edits to a sequence of roles `(s?(ua)+)?` are a shortest path through four states. What is left to pay from
each state is a vector that, less its smallest entry, takes few values; so for every block of BLOCK symbols and every such
vector behind the block a table says the vector before it, the cost, and the state in which a cheapest walk leaves. Tables of
long blocks are made from those of shorter ones. A conversation is read block by block from its end by lookups; then it is
walked from its start, and each block is expanded backward once more to take the least letter among equally cheap edits.

Rows lie in one global order, dealt by ranges, so a long conversation is spread over tasks. It is worked on in chunks: a
chunk is a function from the vector behind it to the vector before it and the states, and the functions of a conversation's
chunks are put together without its rows.
"""
from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ship, stable

#: Costs of the edits, and what a row that is cut short adds if it stays.
DELETE, INSERT, REROLE, SHORT = 2, 5, 1, 5
ROLES = ("system", "user", "assistant")
#: Symbols: twice the kind of role (system, user, assistant, other) and one more if cut short; to be deleted; none.
GONE, NONE, SYMBOLS = 8, 9, 10
BLOCK = 4
#: States: nothing yet, after system, after user, after assistant; and where user or assistant may follow.
STATES, FOLLOW = 4, (2, 2, 3, 2)
END = (0, 10, 5, 0)
TAIL = ("", "II", "I", "")
#: Rows of a chunk: bits of their number.
CHUNK_BITS = 14
BLANKS = " \t\n\x0b\x0c\r"


def _kept(kind: int, state: int) -> int | None:
    """State after a row that keeps its role, if it may."""
    if kind == 0:
        return 1 if state == 0 else None
    return FOLLOW[state] if kind < 3 and FOLLOW[state] == kind + 1 else None


def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """What is left to pay before a symbol, from what is left behind it."""
    if symbol == NONE:
        return after
    out = [DELETE + c for c in after]
    if symbol != GONE:
        for s in range(STATES):
            to = _kept(symbol // 2, s)
            stay = min(REROLE + after[FOLLOW[s]], after[to] if to is not None else 1 << 30)
            out[s] = min(out[s], stay + symbol % 2 * SHORT)
    for _ in range(STATES):
        out = [min(c, INSERT + out[FOLLOW[s]]) for s, c in enumerate(out)]
    return tuple(out)


def _letters(symbol: int, after: tuple[int, ...], state: int) -> tuple[str, tuple[str, ...], int, int]:
    """(letters, role of each, cost, state behind) of the least cheapest edits at one symbol. A kept role is '', a deleted one too."""
    if symbol == NONE:
        return "", (), 0, state
    before, out, roles, paid = _before(symbol, after), "", [], 0
    while True:
        left = before[state]
        follow = FOLLOW[state]
        more = symbol % 2 * SHORT
        if left == DELETE + after[state]:
            return out + "D", (*roles, ""), paid + DELETE, state
        if left == INSERT + before[follow]:
            out, state, paid = out + "I", follow, paid + INSERT
            roles.append(ROLES[follow - 1])
            continue
        to = _kept(symbol // 2, state)
        if to is not None and left == more + after[to]:
            return out + "K", (*roles, ""), paid + more, to
        return out + "R", (*roles, ROLES[follow - 1]), paid + more + REROLE, follow


class Tables:
    """vectors: all that occur, less their smallest entry, the end's first. before, cost: [vector behind, block]; leave: [vector behind, block, state]."""

    def __init__(self) -> None:
        less = lambda v: tuple(c - min(v) for c in v)
        self.vectors, number = [END], {END: 0}
        for v in self.vectors:
            for symbol in range(SYMBOLS):
                w = less(_before(symbol, v))
                if w not in number:
                    number[w] = len(self.vectors)
                    self.vectors.append(w)
        n = len(self.vectors)
        self.one = np.array([[number[less(_before(c, v))] for c in range(SYMBOLS)] for v in self.vectors], np.int16)
        cost = np.array([[min(_before(c, v)) for c in range(SYMBOLS)] for v in self.vectors], np.int64)
        leave = np.array([[[_letters(c, v, s)[3] for s in range(STATES)] for c in range(SYMBOLS)] for v in self.vectors], np.int8)
        self.before, self.cost, self.leave, size = self.one, cost, leave, 1
        while size < BLOCK:
            mid = self.before  # behind the first half: before the second
            first = np.arange(SYMBOLS**size)
            self.cost = (self.cost[:, None, :] + self.cost[mid[:, None, :], first[None, :, None]]).reshape(n, -1)
            between = self.leave[mid[:, None, :], first[None, :, None]]
            self.leave = self.leave[np.arange(n)[:, None, None, None], np.arange(SYMBOLS**size)[None, None, :, None], between].reshape(n, -1, STATES)
            self.before = self.before[mid[:, None, :], first[None, :, None]].reshape(n, -1)
            size *= 2

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """Blocks of a sequence, filled up with symbols that change nothing."""
        full = np.full(-(-len(symbols) // BLOCK) * BLOCK, NONE, np.int64)
        full[: len(symbols)] = symbols
        return full.reshape(-1, BLOCK) @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)

    def function(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every vector behind a sequence: the vector before it, and the state in which each state leaves it."""
        n = len(self.vectors)
        at, leave = np.arange(n), np.tile(np.arange(STATES), (n, 1))
        for code in self.codes(symbols)[::-1]:
            leave = np.take_along_axis(leave, self.leave[at, code].astype(np.int64), axis=1)
            at = self.before[at, code]
        return at, leave

    def walk(self, symbols: np.ndarray, behind: int = 0, state: int = 0) -> tuple[list[str], list[tuple[str, ...]], list[int], int]:
        """(letters, roles, cost) of every row and the state behind, for the vector behind the sequence and the state before it."""
        codes, ends = self.codes(symbols).tolist(), []
        for code in reversed(codes):
            ends.append(behind)
            behind = int(self.before[behind, code])
        letters, roles, costs = [], [], []
        for code, end in zip(codes, reversed(ends)):
            some, state = expanded(code, end, state)
            for a, b, c in some:
                letters.append(a)
                roles.append(b)
                costs.append(c)
        n = len(symbols)
        return letters[:n], roles[:n], costs[:n], state


@functools.cache
def tables() -> Tables:
    return Tables()


@functools.lru_cache(maxsize=1 << 15)
def expanded(code: int, behind: int, state: int) -> tuple[tuple, int]:
    """A block's rows, walked from its start: the vectors inside are found from its end first."""
    t = tables()
    symbols = [code // SYMBOLS**i % SYMBOLS for i in range(BLOCK - 1, -1, -1)]
    inside = [behind]
    for symbol in symbols[:0:-1]:
        inside.append(int(t.one[inside[-1], symbol]))
    out = []
    for symbol, v in zip(symbols, inside[::-1]):
        letters, roles, cost, state = _letters(symbol, t.vectors[v], state)
        out.append((letters, roles, cost))
    return tuple(out), state


RUN = "struct<at: bigint, turn: bigint, is_null: boolean, role: string, digest: string, n: bigint, blank: boolean, fresh: boolean, short: boolean, kind: int>"
EDITS = "key string, at long, turn long, is_null boolean, role string, digest string, n long, letters string, roles array<string>, tail string, cost long, blank long, duplicate long, truncated long, illegal long, turns long"


def _symbols(runs: pa.StructArray) -> np.ndarray:
    blank, fresh, short, kind = (runs.field(c).to_numpy(zero_copy_only=False) for c in ("blank", "fresh", "short", "kind"))
    return np.where(blank | ~fresh, GONE, 2 * kind + short)


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk: its function, and what the next chunk has to know of it."""
    for batch in batches:
        runs = batch.column("runs").flatten()
        symbols, ends = _symbols(runs), np.concatenate(([0], np.cumsum(np.diff(batch.column("runs").offsets.to_numpy()))))
        made = [tables().function(symbols[a:b]) for a, b in zip(ends, ends[1:])]
        last = pa.array(ends[1:] - 1)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("first"), pa.array([a.tolist() for a, _ in made], pa.list_(pa.int32())), pa.array([b.ravel().tolist() for _, b in made], pa.list_(pa.int32())),
                                          runs.field("kind").take(last), runs.field("turn").take(last), runs.field("is_null").take(last)], names=["key", "first", "before", "leave", "kind", "turn", "is_null"])


def _joined(t: pa.Table) -> pa.Table:
    """The vector behind each chunk of a conversation, the state before it and the row before it: one row per chunk."""
    t = t.sort_by("first").combine_chunks()
    n = t.num_rows
    before = np.stack(t.column("before").to_pylist())
    leave = np.stack(t.column("leave").to_pylist()).reshape(n, -1, STATES)
    behind, state = np.zeros(n, np.int32), np.zeros(n, np.int32)
    for i in range(n - 1, 0, -1):
        behind[i - 1] = before[i, behind[i]]
    for i in range(n - 1):
        state[i + 1] = leave[i, behind[i], state[i]]
    was = lambda c: pa.array([None, *t.column(c).to_pylist()[:-1]], t.schema.field(c).type)
    return pa.table({"first": t.column("first"), "behind": behind, "state": state, "is_last": np.arange(n) == n - 1, "kind_was": was("kind"), "turn_was": was("turn"), "null_was": was("is_null")})


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of equal rows: the edits of its first row, as every further one is deleted, and its part of the counts."""
    t = tables()
    legal = np.zeros((5, 5), bool)
    legal[[0, 1, 2], [1, 2, 1]] = True
    for batch in batches:
        sizes = np.diff(batch.column("runs").offsets.to_numpy())
        ends = np.concatenate(([0], np.cumsum(sizes)))
        runs = batch.column("runs").flatten()
        symbols = _symbols(runs)
        get = lambda c: runs.field(c).to_numpy(zero_copy_only=False)
        n, kind, turn, no_turn, blank, fresh = get("n"), get("kind"), get("turn"), get("is_null"), get("blank"), get("fresh")
        letters, roles, costs, tails = [], [], [], [""] * len(symbols)
        columns = (batch.column(c).to_pylist() for c in ("behind", "state", "is_last"))
        for a, b, behind, state, is_last in zip(ends, ends[1:], *columns):
            some, out, cost, state = t.walk(symbols[a:b], 0 if behind is None else behind, state or 0)
            if is_last is None or is_last:
                tails[b - 1] = TAIL[state]
            letters += some
            roles += out
            costs += cost
        head = ends[:-1]
        was, turn_was, null_was, follows = np.roll(kind, 1), np.roll(turn, 1), np.roll(no_turn, 1), np.ones(len(symbols), bool)
        known = batch.column("kind_was").is_valid().to_numpy(zero_copy_only=False)
        was[head] = batch.column("kind_was").fill_null(4).to_numpy(zero_copy_only=False)
        turn_was[head] = batch.column("turn_was").fill_null(0).to_numpy(zero_copy_only=False)
        null_was[head] = batch.column("null_was").fill_null(True).to_numpy(zero_copy_only=False)
        follows[head] = known
        new = ~no_turn & (~follows | null_was | (turn != turn_was))
        stays = ~blank & fresh
        made = [np.array(costs, np.int64) + np.array([INSERT * len(x) for x in tails], np.int64) + DELETE * (n - 1), np.where(blank, n, 0), np.where(blank, 0, n - fresh), np.where(stays & get("short"), 1, 0),
                (follows & ~legal[was, kind]) + (n - 1), new]
        roles = [[*r, *(ROLES[(1 if len(x) == 2 and i == 0 else 2)] for i in range(len(x)))] for r, x in zip(roles, tails)]
        keys = batch.column("key").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        yield pa.RecordBatch.from_arrays([keys, *(runs.field(c) for c in ("at", "turn", "is_null", "role", "digest", "n")), pa.array(letters, pa.string()), pa.array(roles, pa.list_(pa.string())), pa.array(tails, pa.string()),
                                          *(pa.array(x.astype(np.int64)) for x in made)],
                                         names=["key", "at", "turn", "is_null", "role", "digest", "n", "letters", "roles", "tail", "cost", "blank", "duplicate", "truncated", "illegal", "turns"])


def key_of(id_col: Column) -> Column:
    """A conversation's id as text that is never null; the null id is one conversation."""
    return F.coalesce(F.concat(F.lit("v"), id_col.cast("string")), F.lit("null"))


def _rows(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    turn = df[turn_col].cast("long")
    return df.select(key_of(df[id_col]).alias("key"), F.coalesce(turn, F.lit(0).cast("long")).alias("turn"), turn.isNull().alias("is_null"),
                     F.coalesce(df[role_col], F.lit(" ")).alias("role"), F.coalesce(df[text_col], F.lit(" ")).alias("text")).withColumn("digest", F.md5(F.col("text").cast("binary")))


KEYS = ["key", "turn", "is_null", "role", "digest"]


def edits(rows: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """One row per run of equal rows (EDITS), from rows of key, turn, is_null, role, text and digest. Written to the shared folder."""
    ship(rows.sparkSession)
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    runs = rows.select(*KEYS, (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("short")).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.max("blank").alias("blank"), F.max("short").alias("short"))
    order = [F.col("key"), F.col("is_null").desc(), F.col("turn"), F.col("role"), F.col("digest")]
    ordered = stable(runs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "order")
    firsts = ordered.groupBy("key", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("fresh"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    run = F.struct("at", "turn", "is_null", "role", "digest", "n", "blank", F.coalesce("fresh", F.lit(False)).alias("fresh"), "short", kind.cast("int").alias("kind"))
    chunks = ordered.join(firsts, "at", "left").groupBy("key", F.shiftright("at", chunk_bits).alias("window")).agg(F.array_sort(F.collect_list(run)).alias("runs"))  # at most 2^chunk_bits runs
    chunks = stable(chunks.select("key", F.col("runs")[0]["at"].alias("first"), F.col("runs").cast(f"array<{RUN}>").alias("runs")), "chunks")
    split = chunks.groupBy("key").agg(F.min("first").alias("lo"), F.max("first").alias("hi")).filter("lo < hi").select("key")
    parts = chunks.join(split, "key", "left_semi").mapInArrow(_functions, "key string, first long, before array<int>, leave array<int>, kind int, turn long, is_null boolean")
    context = parts.groupBy("key").applyInArrow(_joined, "first long, behind int, state int, is_last boolean, kind_was int, turn_was long, null_was boolean")
    return stable(chunks.join(context, "first", "left").mapInArrow(_edits, EDITS), "edits")


def _turns(rows: DataFrame, made: DataFrame) -> DataFrame:
    """The edits with turns: what stands in the place of each run, as an array of (role, text)."""
    texts = rows.groupBy(*KEYS).agg(F.first("text").alias("text"))
    letters = F.split(F.concat("letters", "tail"), "")
    def turn(letter: Column, i: Column) -> Column:
        role = F.when(letter == "K", F.col("role")).otherwise(F.get("roles", i))
        return F.when(letter != "D", F.struct(role.alias("role"), F.when(letter == "I", "").otherwise(F.col("text")).alias("text"), letter.alias("edit")))
    return made.join(texts, KEYS, "left").withColumn("turns", F.filter(F.transform(letters, turn), lambda x: x.isNotNull()))


def repaired(df: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """The turns of every conversation after the cheapest edits: id, at and place (their order), edit (K, R or I), role, text.

    Input rows are taken by turn (null first), then role, then a hash of the text. A null role or text is one space. Blank
    texts and those whose role and text stood earlier are deleted; texts that do not end in `.`, `!` or `?` cost 5 if they
    stay. Of equally cheap edits the least by letters (D, I, K, R) is taken. Conversations that keep nothing have no rows;
    the null id is one conversation; an empty table gives an empty result; other columns are not returned.
    """
    rows = _rows(df, id_col, turn_col, role_col, text_col)
    ids = df.groupBy(key_of(df[id_col]).alias("key")).agg(F.first(df[id_col]).alias(id_col))
    turns = _turns(rows, edits(rows, chunk_bits)).select("key", "at", F.posexplode("turns").alias("place", "turn"))
    return turns.join(ids, "key").select(id_col, "at", "place", "turn.edit", "turn.role", "turn.text")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, audit, sha256) of conversations whose runs come in order: held are the letters, never the texts."""
    key, audit, digest, lines = None, [], None, 0
    for batch in batches:
        done = []
        for k, letters, text in zip(*(batch.column(c).to_pylist() for c in ("key", "letters", "lines"))):
            if k != key:
                if digest is not None:
                    done.append((key, "".join(audit), digest.hexdigest()))
                key, audit, digest, lines = k, [], hashlib.sha256(), 0
            audit.append(letters)
            if text is not None:
                digest.update((("\n" if lines else "") + text).encode("utf-8", "surrogatepass"))
                lines += 1
        yield pa.RecordBatch.from_pylist([dict(zip(("key", "audit", "sha256"), d)) for d in done], schema=FOLDED)
    if digest is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "audit": "".join(audit), "sha256": digest.hexdigest()}], schema=FOLDED)


FOLDED = pa.schema([("key", pa.string()), ("audit", pa.string()), ("sha256", pa.string())])


def report(df: DataFrame, *, ids: DataFrame | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """One row per conversation of `ids` (df, if not given): gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 of the lines `role:text`. Rows and edits as in repaired(); a conversation without rows has zeros, an
    empty audit and the hash of nothing. A conversation's hash and audit are made by one task, which streams its rows.
    """
    rows = _rows(df, id_col, turn_col, role_col, text_col)
    made = edits(rows, chunk_bits)
    span = [F.max(F.when(~F.col("is_null"), F.col("turn"))), F.min(F.when(~F.col("is_null"), F.col("turn")))]
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    sums = made.groupBy("key").agg((span[0] - span[1] + 1 - F.sum("turns")).alias("gaps"), *[F.sum(c).alias(c) for c in counts])
    lines = F.transform("turns", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    again = F.when(F.col("n") > 1, F.repeat(F.lit("D"), (F.col("n") - 1).cast("int"))).otherwise("")
    told = _turns(rows, made).select("key", "at", F.concat("letters", again, "tail").alias("letters"), F.when(F.size("turns") > 0, F.concat_ws("\n", lines)).alias("lines"))
    folded = told.repartition("key").sortWithinPartitions("key", "at").mapInArrow(_folded, "key string, audit string, sha256 string")
    every = df if ids is None else ids
    every = every.groupBy(key_of(every[id_col]).alias("key")).agg(F.first(every[id_col]).alias(id_col))
    out = every.join(sums, "key", "left").join(folded, "key", "left")
    return out.select(id_col, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *counts)], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(df: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows with planted faults, by crc32 of `id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes `.!?` out of
    it, 3 repeats it, 4 makes its role user. Nulls of role and text become one space, in the crc too."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank(df[id_col]), F.lit(":"), blank(df[turn_col])).cast("binary")) % 20
    rows = df.select(df[id_col].alias("id"), df[turn_col].alias("turn"), blank(df[role_col]).alias("role"), blank(df[text_col]).alias("text"), fault.alias("fault")).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))
    return rows.select(F.col("id").alias(id_col), F.col("turn").alias(turn_col), role.alias(role_col), text.alias(text_col), F.explode(times).alias("copy")).drop("copy")
