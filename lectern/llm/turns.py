"""Conversation structure repair by Four-Russians block tables.

A conversation's rows are symbols: the initial of the role (s, u, a or another) and whether the row is plain,
ends truncated, or has to go (blank, or said before). Keep, rerole, delete and insert turn the role
initials into ``(s?(ua)+)?``, whose automaton has four states. ``cost[state]`` is the least price of the rest
of the conversation from a state on; less their least entry, only some dozens of such vectors exist. For each of them and
each block of ``BLOCK`` symbols a table gives the vector in front of the block and the price that goes off, so a
conversation is priced from its end by one lookup a block. Tracing then goes forward and expands one block
at a time backward into its single vectors, so that among the cheapest edits the ASCII-least are taken.

Rows are numbered within their conversation by range partitioning and cut into chunks of ``CHUNK`` rows, so a
conversation of any length spreads over tasks. A chunk is summed up by its cost from each state to each
state; chunks of one conversation are combined level by level, ``CHUNK`` at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import query, table
from lectern.plans.ranking import number_rows
from lectern.plans.scratch import settle

BLOCK = 4
#: Rows of a chunk, and chunks of a chunk of the next level.
CHUNK = 4096
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Above every price that can occur; stands for "not possible".
NEVER = 1 << 20
#: Symbols: role class (s, u, a, other) plus four times "truncated"; the last one has to go.
GONE, SYMBOLS = 8, 9
#: The automaton: nothing yet, after s, after u, after a. What an inserted or new role leads to, by state.
STATES = 4
_NEXT = (2, 2, 3, 2)
_ROLE = ("u", "u", "a", "u")
_KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}  # state, role class: next state
_END = (0, NEVER, NEVER, 0)


def _moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Edit, price and next state of everything that can be done with a row, in the order of the edits' initials."""
    out = [("D", DELETE, state)]
    if symbol != GONE:
        cut = CUT * (symbol // 4)
        if (state, symbol % 4) in _KEPT:
            out.append(("K", KEEP + cut, _KEPT[state, symbol % 4]))
        out.append(("R" + _ROLE[state], REROLE + cut, _NEXT[state]))
    return out


def _inserted(cost: list[int]) -> list[int]:
    """Costs with any number of inserts in front."""
    for _ in range(STATES):
        cost = [min(cost[s], INSERT + cost[_NEXT[s]]) for s in range(STATES)]
    return [min(c, NEVER) for c in cost]


def _before(symbol: int, cost: list[int]) -> list[int]:
    """Costs in front of a row, from those after it."""
    return _inserted([min(price + cost[to] for _, price, to in _moves(symbol, s)) for s in range(STATES)])


def _normal(cost: list[int]) -> tuple[tuple[int, ...], int]:
    least = min(cost)
    return tuple(c if c >= NEVER // 2 else c - least for c in cost), least


class Tables:
    """All normalised cost vectors, and where each block of symbols leads."""

    def __init__(self):
        units = [tuple(0 if s == e else NEVER for s in range(STATES)) for e in range(STATES)]
        starts = [_inserted(list(c)) for c in (_END, *units)]
        self.vectors = list(dict.fromkeys(_normal(c)[0] for c in starts))
        self.at = {v: i for i, v in enumerate(self.vectors)}
        one: list[list[tuple[int, int]]] = []
        while len(one) < len(self.vectors):  # grows until no new vector comes up
            row = []
            for symbol in range(SYMBOLS):
                cost, off = _normal(_before(symbol, list(self.vectors[len(one)])))
                if cost not in self.at:
                    self.at[cost] = len(self.vectors)
                    self.vectors.append(cost)
                row.append((self.at[cost], off))
            one.append(row)
        lead, off = np.array(one, np.int64).transpose(2, 0, 1)  # by vector after the row and symbol
        self.lead, self.off = [lead], [off]
        for _ in range(1, BLOCK):  # one symbol more in front: vector, then the symbols from last to first
            back, add = self.lead[-1], self.off[-1]
            self.lead.append(lead[back].reshape(len(lead), -1))
            self.off.append((add[:, :, None] + off[back]).reshape(len(lead), -1))
        self.start = {e: _normal(c) for e, c in zip((None, *range(STATES)), starts, strict=True)}

    def blocks(self, symbols: np.ndarray) -> list[tuple[int, int]]:
        """Length and number of each block, from the last one to the first."""
        out, end = [], len(symbols)
        while end > 0:
            n, code = min(BLOCK, end), 0
            for symbol in symbols[end - n:end][::-1].tolist():
                code = code * SYMBOLS + symbol
            out.append((n, code))
            end -= n
        return out

    def price(self, blocks: list[tuple[int, int]], cost: tuple[int, ...]) -> tuple[tuple[int, ...], list[int]]:
        """Costs in front of the blocks, from those after them, and the vectors after each block."""
        least = min(cost)
        normal, total = _normal(list(cost))
        v, after = self.at[normal], []
        for n, code in blocks:
            after.append(v)
            v, total = int(self.lead[n - 1][v, code]), total + int(self.off[n - 1][v, code])
        return tuple(c if c >= NEVER // 2 else c + total for c in self.vectors[v]), after

    @lru_cache(maxsize=200_000)  # noqa: B019
    def trace(self, n: int, code: int, after: int, state: int) -> tuple[tuple[str, ...], tuple[int, ...], int]:
        """Edits of each row of a block, their prices, and the state behind it."""
        symbols = []
        for _ in range(n):
            symbols.append(code % SYMBOLS)
            code //= SYMBOLS
        costs = [list(self.vectors[after])]
        for symbol in symbols[::-1]:  # the block expanded backward
            costs.append(_before(symbol, costs[-1]))
        costs.reverse()
        edits, prices = [], []
        for symbol, here, then in zip(symbols, costs, costs[1:], strict=False):
            row, price = "", 0
            while True:
                # the initials in ASCII order: delete, insert, keep, rerole
                choices = [(m[0], m[1], m[2], then[m[2]], True) for m in _moves(symbol, state)]
                choices.append(("I" + _ROLE[state], INSERT, _NEXT[state], here[_NEXT[state]], False))
                edit, paid, state_, _, done = min(c for c in choices if c[1] + c[3] == here[state])
                row, price, state = row + edit, price + paid, state_
                if done:
                    break
            edits.append(row)
            prices.append(price)
        return tuple(edits), tuple(prices), state


@cache
def tables() -> Tables:
    return Tables()


def _finish(state: int) -> str:
    """Inserts that end a conversation; which rows they follow is decided by the costs."""
    out = ""
    while _END[state]:
        out, state = out + "I" + _ROLE[state], _NEXT[state]
    return out


def _codes(symbols: str) -> np.ndarray:
    return np.frombuffer(symbols.encode(), np.uint8).astype(np.int64) - 48


_LEVEL = "key string, chunk bigint, cost array<int>"


def _summed(chunks: DataFrame) -> DataFrame:
    """``key, chunk, cost``: of each chunk ``key, chunk, symbols`` the least price from each state (row) to each (column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        units = [tuple(0 if s == e else NEVER for s in range(STATES)) for e in range(STATES)]
        for batch in batches:
            cost = []
            for symbols in batch.column(2).to_pylist():
                blocks = t.blocks(_codes(symbols))
                # inserts behind the last row belong to what follows, so no insert is counted twice
                ends = [t.price(blocks, tuple(_inserted(list(u))))[0] for u in units]
                cost.append([ends[e][s] for s in range(STATES) for e in range(STATES)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cost, pa.list_(pa.int32()))], ["key", "chunk", "cost"])

    return chunks.select("key", "chunk", "symbols").mapInArrow(run, _LEVEL)


def _behind(cost: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs in front of a chunk from its summary and the costs behind it."""
    return np.minimum((cost.reshape(STATES, STATES) + after[None, :]).min(axis=1), NEVER)


def _cost_ends(level: DataFrame) -> DataFrame:
    """``key, chunk, after``: the costs behind each chunk of ``key, chunk, cost``.

    Groups of ``CHUNK`` chunks are summed up to chunks of a higher level until one is left of each conversation.
    """
    most = level.agg(F.max("chunk")).first()[0] or 0
    up = level.withColumn("up", F.floor(F.col("chunk") / CHUNK))
    group = up.groupBy("key", "up").agg(F.array_sort(F.collect_list(F.struct("chunk", "cost"))).alias("parts"))
    if most == 0:  # one chunk each: nothing is behind it
        return level.select("key", "chunk", F.array(*[F.lit(int(c)) for c in _inserted(list(_END))]).alias("after"))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(2).to_pylist():
                cost = [np.array([0 if s == e else NEVER for s in range(STATES)], np.int64) for e in range(STATES)]
                for part in parts[::-1]:
                    cost = [_behind(np.array(part["cost"], np.int64), c) for c in cost]
                out.append(np.array(cost).T.ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["key", "chunk", "cost"])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, chunks, afters = [], [], []
            for key, parts, after in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                after = np.array(after, np.int64)
                for part in parts[::-1]:
                    keys.append(key)
                    chunks.append(part["chunk"])
                    afters.append(after.tolist())
                    after = _behind(np.array(part["cost"], np.int64), after)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(chunks, pa.int64()), pa.array(afters, pa.list_(pa.int32()))], ["key", "chunk", "after"])

    group = settle(group, "cost_groups")
    above = _cost_ends(settle(group.mapInArrow(total, _LEVEL), "cost_level"))
    joined = group.join(above.withColumnRenamed("chunk", "up"), ["key", "up"]).select("key", "parts", "after")
    return joined.mapInArrow(down, "key string, chunk bigint, after array<int>")


def _traced(symbols: str, after: list[int], state: int, last: bool) -> tuple[list[str], int, int]:
    """Edits of the rows of a chunk that starts in ``state``, their price, and the state behind them."""
    t = tables()
    blocks = t.blocks(_codes(symbols))
    _, vectors = t.price(blocks, tuple(after))
    edits: list[str] = []
    total = 0
    for (n, code), v in zip(blocks[::-1], vectors[::-1], strict=True):
        own, prices, state = t.trace(n, code, v, state)
        edits += own
        total += sum(prices)
    if last:
        edits[-1] += _finish(state)
        total += INSERT * (len(_finish(state)) // 2)
    return edits, total, state


_MAP = "key string, chunk bigint, to array<int>"


def _state_starts(level: DataFrame) -> DataFrame:
    """``key, chunk, state``: the state in front of each chunk of ``key, chunk, to`` (state behind it by state in front)."""
    most = level.agg(F.max("chunk")).first()[0] or 0
    if most == 0:
        return level.select("key", "chunk", F.lit(0).alias("state"))
    up = level.withColumn("up", F.floor(F.col("chunk") / CHUNK))
    group = settle(up.groupBy("key", "up").agg(F.array_sort(F.collect_list(F.struct("chunk", "to"))).alias("parts")), "state_groups")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(2).to_pylist():
                to = list(range(STATES))
                for part in parts:
                    to = [part["to"][s] for s in to]
                out.append(to)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["key", "chunk", "to"])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, parts, state in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for part in parts:
                    rows.append((key, part["chunk"], state))
                    state = part["to"][state]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            kinds = [pa.string(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "chunk", "state"])

    above = _state_starts(settle(group.mapInArrow(total, _MAP), "state_level"))
    joined = group.join(above.withColumnRenamed("chunk", "up"), ["key", "up"]).select("key", "parts", "state")
    return joined.mapInArrow(down, "key string, chunk bigint, state int")


def _edits(chunks: DataFrame) -> DataFrame:
    """``key, chunk, edits, cost``: the cheapest edits of the rows of ``key, chunk, symbols, last``."""
    ends = _cost_ends(settle(_summed(chunks), "chunk_costs"))
    ready = settle(chunks.join(ends, ["key", "chunk"]).select("key", "chunk", "symbols", "after", "last"), "priced")

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = [
                [_traced(symbols, after, s, False)[2] for s in range(STATES)] if not last else list(range(STATES))
                for symbols, after, last in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(to, pa.list_(pa.int32()))], ["key", "chunk", "to"])

    starts = _state_starts(settle(ready.mapInArrow(states, _MAP), "chunk_states"))

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_traced(*row) for row in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.list_(pa.string())),
                 pa.array([f[1] for f in found], pa.int64())], ["key", "chunk", "edits", "cost"])

    full = ready.join(starts, ["key", "chunk"]).select("key", "chunk", "symbols", "after", "state", "last")
    return full.mapInArrow(trace, "key string, chunk bigint, edits array<string>, cost bigint")


_SPACE = r"[\x20\x09-\x0D]"


def _key(conv: Column) -> Column:
    """Never null, so that rows without a conversation are one conversation and join."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def repair(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The repaired rows, and a report of each conversation.

    Rows: ``conv_id, rn, step, edit, role, text``; a row ``rn`` of the input (by turn, nulls first, then role and
    text digest) has a line for each of its edits (K, R, D, and I for rows that were put in), a deleted one has no role and
    text. Report: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost``. A null role or text counts as one space, a
    null conversation id as one conversation. Repeated rows are duplicates. Other columns are not read.
    """
    space = F.lit(" ")
    rows = df.select(
        _key(F.col(conv_col)).alias("key"), F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"),
    )
    rows = settle(rows.withColumn("uid", F.monotonically_increasing_id()), "turns")
    bare = F.regexp_replace("text", f"{_SPACE}+$", "")
    slim = rows.select(
        "uid", "key", "conv_id", "turn", "role", F.unhex(F.md5("text")).alias("body"), F.substring("role", 1, 1).alias("initial"),
        (F.length(bare) == 0).alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("body"), F.col("uid")]
    slim = number_rows(slim, order, ["key"])
    slim = settle(slim.withColumn("chunk", F.floor((F.col("rn") - 1) / CHUNK)), "numbered")

    first = slim.groupBy("key", "role", "body").agg(F.min("rn").alias("first"))
    marked = slim.join(first, ["key", "role", "body"])
    duplicate = ~F.col("blank") & (F.col("rn") > F.col("first"))
    cut = ~F.col("blank") & ~duplicate & F.col("open")
    kind = F.coalesce(*[F.when(F.col("initial") == c, F.lit(i)) for i, c in enumerate("sua")], F.lit(3))
    symbol = F.when(F.col("blank") | duplicate, F.lit(GONE)).otherwise(kind + 4 * cut.cast("int")).cast("string")
    marked = marked.select("key", "conv_id", "chunk", "rn", "turn", "initial", symbol.alias("symbol"), "blank", duplicate.alias("duplicate"), cut.alias("cut"))
    held = F.array_sort(F.collect_list(F.struct("rn", "symbol", "initial"))).alias("held")
    count = lambda c: F.sum(F.col(c).cast("bigint")).alias(c)
    chunks = marked.groupBy("key", "chunk").agg(held, F.first("conv_id").alias("conv_id"), count("blank"), count("duplicate"), count("cut"))
    pair = lambda a, b: ~F.concat(a, b).isin("su", "ua", "au")
    inside = F.zip_with(F.slice("held", 1, F.size("held") - 1), F.slice("held", 2, F.size("held") - 1), lambda a, b: pair(a["initial"], b["initial"]))
    chunks = settle(chunks.select(
        "key", "chunk", "conv_id", "blank", "duplicate", "cut", F.array_join(F.transform("held", lambda x: x["symbol"]), "").alias("symbols"),
        F.size(F.filter(inside, lambda x: x)).cast("bigint").alias("illegal"),
        F.element_at("held", 1)["initial"].alias("head"), F.element_at("held", -1)["initial"].alias("tail"),
    ), "chunks")
    # two neighbours in different chunks
    before = chunks.select("key", (F.col("chunk") + 1).alias("chunk"), F.col("tail").alias("before"))
    end = chunks.groupBy("key").agg(F.max("chunk").alias("end"))
    chunks = settle(chunks.join(before, ["key", "chunk"], "left").join(end, "key").select(
        "key", "chunk", "conv_id", "blank", "duplicate", "cut", "symbols", (F.col("chunk") == F.col("end")).alias("last"),
        (F.col("illegal") + F.when(F.col("before").isNotNull() & pair(F.col("before"), F.col("head")), 1).otherwise(0)).alias("illegal"),
    ), "chunk_rows")
    edits = settle(_edits(chunks), "edits")

    turns = slim.groupBy("key", "turn").agg(F.count(F.lit(1)).alias("n")).where("turn IS NOT NULL").groupBy("key")
    gaps = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("bigint").alias("gaps"))
    counts = chunks.groupBy("key").agg(
        F.first("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "cut", "illegal")])
    cost = edits.groupBy("key").agg(F.sum("cost").alias("cost"))
    report = counts.join(gaps, "key", "left").join(cost, "key").select(
        "conv_id", F.coalesce("gaps", F.lit(0)).cast("bigint").alias("gaps"), "blank", "duplicate", F.col("cut").alias("truncated"), "illegal", "cost")

    own = F.element_at("edits", (F.col("rn") - F.col("chunk") * CHUNK).cast("int"))
    moves = slim.select("uid", "key", "chunk", "rn").join(edits.select("key", "chunk", "edits"), ["key", "chunk"])
    steps = rows.select("uid", "conv_id", "role", "text").join(moves.select("uid", "rn", own.alias("moves")), "uid")
    steps = steps.select("conv_id", "rn", "role", "text", F.posexplode(F.regexp_extract_all("moves", F.lit("[DIKR][ua]?"), F.lit(0))).alias("step", "move"))
    edit = F.substring("move", 1, 1)
    new = F.when(F.col("move").endswith("u"), "user").otherwise("assistant")
    role = F.when(edit == "K", F.col("role")).when(edit != "D", new)
    text = F.when(edit == "I", "").when(edit != "D", F.col("text"))
    return steps.select("conv_id", "rn", "step", edit.alias("edit"), role.alias("role"), text.alias("text")), report


def digests(rows: DataFrame) -> DataFrame:
    """``conv_id, audit, repaired_sha256`` of repaired rows.

    A digest over a whole conversation has to see its rows one after the other, in one task; they stream
    through it in order, and nothing of them is held but the digest and the initials of the edits.
    """
    slim = rows.withColumn("key", _key(F.col("conv_id")))
    ordered = slim.repartition("key").sortWithinPartitions("key", "rn", "step").select("key", "conv_id", "edit", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, conv, audit, first, digest = None, None, [], True, None
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 3
            arrays = [pa.array(c, k) for c, k in zip(columns, (conv_type, pa.string(), pa.string()), strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            conv_type = batch.column(1).type
            for k, c, edit, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if k != key:
                    if key is not None:
                        done.append((conv, "".join(audit), digest.hexdigest()))
                    key, conv, audit, first, digest = k, c, [], True, hashlib.sha256()
                audit.append(edit)
                if edit != "D":
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            yield out()
        if key is not None:
            done.append((conv, "".join(audit), digest.hexdigest()))
            yield out()

    return ordered.mapInArrow(run, f"conv_id {kind}, audit string, repaired_sha256 string")


def damage(df: DataFrame) -> DataFrame:
    """``conversations`` with every twentieth row dropped, emptied, without sentence ends, repeated, or from the user."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    mark = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), mark.alias("mark")).where("mark <> 0")
    text = F.when(F.col("mark") == 1, "").when(F.col("mark") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("mark") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("mark") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("copy")).drop("copy")


#: The same by a table of the cheapest edits up to each row, state by state; ``t`` is the table of crc32.
REPAIR_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT range AS i, range AS v, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
m AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
    lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS mark
  FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN mark = 4 THEN 'user' ELSE role END AS role,
  CASE mark WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN mark = 3 THEN 2 ELSE 1 END)) AS copy
  FROM m WHERE mark <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS rn,
  regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare, substr(role, 1, 1) AS ini FROM d),
f AS (SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS dup,
  right(bare, 1) NOT IN ('.', '!', '?') AS open, lag(ini) OVER (PARTITION BY conv_id ORDER BY rn) || ini AS pair FROM n),
s AS (SELECT *, NOT blank AND NOT dup AND open AS cut, (NOT blank AND NOT dup AND open)::INT AS extra FROM f),
r AS (
  SELECT conv_id, 0::BIGINT AS rn, [{k: 0::BIGINT, a: '', t: []::VARCHAR[]}, NULL, {k: 2::BIGINT, a: 'I', t: ['user:']}, {k: 4::BIGINT, a: 'II', t: ['user:', 'assistant:']}] AS e
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, rn, [e[1], e[2], u, list_min(list_concat([e[4]], CASE WHEN u IS NULL THEN [] ELSE [{k: u.k + 2, a: u.a || 'I', t: list_append(u.t, 'assistant:')}] END))]
  FROM (SELECT conv_id, rn, e, list_min(list_concat([e[3]], list_transform(list_filter([e[1], e[2], e[4]], lambda x: x IS NOT NULL),
      lambda x: {k: x.k + 2, a: x.a || 'I', t: list_append(x.t, 'user:')}))) AS u
    FROM (SELECT r.conv_id, s.rn, list_transform([
        list_concat(list_transform([e[1]], lambda x: {k: x.k + 3, a: x.a || 'D', t: x.t})),
        list_concat(list_transform([e[2]], lambda x: {k: x.k + 3, a: x.a || 'D', t: x.t}),
          list_transform(CASE WHEN go OR ini <> 's' THEN [] ELSE [e[1]] END, lambda x: {k: x.k + extra, a: x.a || 'K', t: list_append(x.t, role || ':' || text)})),
        list_concat(list_transform([e[3]], lambda x: {k: x.k + 3, a: x.a || 'D', t: x.t}),
          list_transform(CASE WHEN go OR ini <> 'u' THEN [] ELSE [e[1], e[2], e[4]] END, lambda x: {k: x.k + extra, a: x.a || 'K', t: list_append(x.t, role || ':' || text)}),
          list_transform(CASE WHEN go THEN [] ELSE [e[1], e[2], e[4]] END, lambda x: {k: x.k + 2 + extra, a: x.a || 'R', t: list_append(x.t, 'user:' || text)})),
        list_concat(list_transform([e[4]], lambda x: {k: x.k + 3, a: x.a || 'D', t: x.t}),
          list_transform(CASE WHEN go OR ini <> 'a' THEN [] ELSE [e[3]] END, lambda x: {k: x.k + extra, a: x.a || 'K', t: list_append(x.t, role || ':' || text)}),
          list_transform(CASE WHEN go THEN [] ELSE [e[3]] END, lambda x: {k: x.k + 2 + extra, a: x.a || 'R', t: list_append(x.t, 'assistant:' || text)}))
      ], lambda l: list_min(list_filter(l, lambda x: x.k IS NOT NULL))) AS e
      FROM r JOIN (SELECT *, blank OR dup AS go FROM s) s ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND s.rn = r.rn + 1))
),
z AS (SELECT conv_id, list_min(list_filter([e[1], e[4]], lambda x: x IS NOT NULL)) AS best FROM r
  WHERE rn = (SELECT count(*) FROM s WHERE s.conv_id IS NOT DISTINCT FROM r.conv_id)),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
  count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM s GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.k::BIGINT AS cost, best.a AS audit,
  sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM z LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM z.conv_id
"""


@query(REPAIR_SQL)
def op12_turn_repair(spark, sf):
    """Every conversation after damage and repair."""
    source = table(spark, sf, "conversations")
    rows, report = repair(damage(source))
    keyed = lambda d: d.withColumn("key", _key(F.col("conv_id")))
    found = keyed(report).join(keyed(digests(rows)).drop("conv_id"), "key").drop("conv_id")
    every = keyed(source.select("conv_id").distinct())
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = every.join(found, "key", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
