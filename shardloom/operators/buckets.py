"""Token buckets along clients of any size, in slices.

What a stretch of one client's requests does to its bucket is a small table. The
mark of a bucket moves to the first request by which a whole token has come in,
whatever the tokens; between two such refills every request takes one token. So
from each request that may be the first refill of the stretch on, the marks are
known, and the tokens go through a shift between two bounds - a form that stays
the same when stretches follow each other. A slice of the ordered table writes
its decisions for clients that begin in it, and for the client that may have
begun before it that table. Tables are put together a few at a time, states are
handed back down, and the open rows are decided with them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.session import settled

TOGETHER = 16  # tables that one step puts together
DECIDED, OPEN, TABLE, TAIL = range(4)
NEVER = 1 << 60


def tokens_after(elapsed: np.ndarray, rate: float) -> np.ndarray:
    """Whole tokens that come in over so many microseconds."""
    return ((elapsed // 1_000_000 + (elapsed % 1_000_000 * 1000) / 1e9) * rate).astype(np.int64)


def pause_for_one(rate: float) -> int:
    """The shortest pause, in microseconds, that brings a token."""
    low, high = 0, NEVER
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if rate > 0 and int((middle // 1_000_000 + (middle % 1_000_000 * 1000) / 1e9) * rate) else (middle, high)
    return high


@dataclass
class Shift:
    """x -> min(max(x + by, low), high), one for each place of the arrays."""

    by: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __getitem__(self, at) -> Shift:
        return Shift(self.by[at], self.low[at], self.high[at])

    def __call__(self, x):
        return np.minimum(np.maximum(x + self.by, self.low), self.high)

    def then(self, after: Shift) -> Shift:
        return Shift(self.by + after.by, after(self.low), after(self.high))

    def put(self, at, other: Shift) -> None:
        self.by[at], self.low[at], self.high[at] = other.by, other.low, other.high

    @staticmethod
    def taking(count: np.ndarray, burst: int) -> Shift:
        """So many requests without a refill."""
        return Shift(-count, np.zeros_like(count), np.full_like(count, burst))

    @staticmethod
    def refill(added: np.ndarray, burst: int) -> Shift:
        """A request that ``added`` tokens (none at all, too) come in by."""
        return Shift(added - 1, np.zeros_like(added), np.full_like(added, max(burst - 1, 0)))


@dataclass
class Stretch:
    """What a stretch of one client's requests does, by the request of its first refill."""

    at: np.ndarray  # times of the requests that may be the first refill
    before: np.ndarray  # requests of the stretch before each
    mark: np.ndarray  # mark at the end, if that is the first refill
    shift: Shift  # tokens from behind it to the end
    requests: int
    first: int  # time of the first request

    @staticmethod
    def of(t: np.ndarray, need: int, rate: float, burst: int) -> Stretch:
        n = len(t)
        jump = np.searchsorted(t, t + need, "left")
        jump = np.append(np.maximum(jump, np.arange(n) + 1), n)
        inside = np.flatnonzero(jump[:n] < n)
        shift = Shift.taking(np.append(jump[:n] - 1 - np.arange(n), 0), burst)
        target = jump[inside]
        refill = Shift.refill(np.minimum(tokens_after(t[target] - t[inside], rate), burst), burst)
        shift.put(inside, shift[inside].then(refill))
        # Behind the last place nothing happens any more.
        shift.put(n, Shift(np.int64(0), np.int64(0), np.int64(burst)))
        last = np.arange(n + 1)
        while (jump[:n] < n).any():
            go = np.flatnonzero(jump < n)
            last[go] = last[jump[go]]
            shift.put(go, shift[go].then(shift[jump[go]]))
            jump[go] = jump[jump[go]]
        entries = np.arange(min(n, int(np.searchsorted(t, t[0] + need, "left")) + 1))
        return Stretch(t[entries], entries, t[last[entries]], shift[entries], n, int(t[0]))

    def followed(self, after: Stretch, need: int, rate: float, burst: int) -> Stretch:
        place = np.searchsorted(after.at, self.mark + need, "left")
        refills = place < len(after.at)
        shift = self.shift.then(Shift.taking(np.where(refills, after.before[np.minimum(place, len(after.at) - 1)], after.requests), burst))
        mark = self.mark.copy()
        on = np.flatnonzero(refills)
        to = place[on]
        added = np.minimum(tokens_after(after.at[to] - mark[on], rate), burst)
        shift.put(on, shift[on].then(Shift.refill(added, burst)).then(after.shift[to]))
        mark[on] = after.mark[to]
        out = Stretch(self.at, self.before, mark, shift, self.requests + after.requests, self.first)
        if self.at[-1] < self.first + need:
            # The first refill may also come behind this stretch.
            both = [np.concatenate(x) for x in ((self.at, after.at), (self.before, after.before + self.requests), (mark, after.mark), *zip((shift.by, shift.low, shift.high), (after.shift.by, after.shift.low, after.shift.high)))]
            out = Stretch(*both[:3], Shift(*both[3:]), out.requests, out.first)
        return out

    def applied(self, tokens: int, mark: int, need: int, rate: float, burst: int) -> tuple[int, int]:
        k = int(np.searchsorted(self.at, mark + need, "left"))
        if k == len(self.at):
            return max(tokens - self.requests, 0), mark
        tokens = max(tokens - int(self.before[k]), 0)
        added = int(tokens_after(np.array([self.at[k] - mark]), rate)[0])
        return int(self.shift[k](max(min(tokens + added, burst) - 1, 0))), int(self.mark[k])


def decide(t: np.ndarray, heads: np.ndarray, tokens: np.ndarray, marks: np.ndarray, need: int, rate: float, burst: int):
    """(allowed, tokens left, mark) of each request; runs of requests start at ``heads`` with these buckets."""
    n, runs = len(t), len(heads)
    run = np.repeat(np.arange(runs), np.diff(np.append(heads, n)))
    # The first request of the run that a pause after each request, or after the first mark, leads to.
    wanted = np.concatenate([t, marks]) + need
    of = np.concatenate([run, np.arange(runs)])
    order = np.lexsort((np.repeat([1, 0], [n, n + runs]), np.concatenate([t, wanted]), np.concatenate([run, of])))
    passed = np.empty(2 * n + runs, np.int64)
    passed[order] = np.cumsum(order < n)
    jump = passed[n:]
    found = (jump < n) & (run[np.minimum(jump, n - 1)] == of)
    jump = np.where(found, jump, n)
    # All refills: what the chains of jumps from the first ones reach.
    refills = np.zeros(n + 1, bool)
    refills[jump[n:]] = True
    hop = np.append(np.maximum(jump[:n], np.arange(n) + 1), n)
    hop[:n][~found[:n]] = n
    while (hop[:n] < n).any():
        refills[hop[refills]] = True
        hop = hop[hop]
    refills = refills[:n]
    place = np.where(refills, np.arange(n), -1)
    latest = np.maximum.accumulate(place)
    here = latest >= heads[run]
    mark = np.where(here, t[np.maximum(latest, 0)], marks[run])
    before = np.concatenate([[-1], latest[:-1]])
    mark_before = np.where(before >= heads[run], t[np.maximum(before, 0)], marks[run])
    added = np.where(refills, tokens_after(np.where(refills, t - mark_before, 0), rate), 0)
    shift = Shift.refill(np.minimum(added, burst), burst)
    step, longest = 1, int(np.diff(np.append(heads, n)).max())
    since = np.arange(n) - heads[run]
    while step < longest:
        on = np.flatnonzero(since >= step)
        shift.put(on, shift[on - step].then(shift[on]))
        step *= 2
    left = shift(tokens[run])
    had = np.where(since == 0, tokens[run], np.concatenate([[0], left[:-1]]))
    return np.minimum(had + added, burst) > 0, left, mark


class _Rule:
    def __init__(self, rate: float, burst: int):
        self.rate, self.burst, self.need = rate, burst, pause_for_one(rate)

    def args(self):
        return self.need, self.rate, self.burst

    def decided(self, t, heads, tokens, marks):
        return decide(t, heads, tokens, marks, *self.args())


COLUMNS = ["at_us", "allowed", "tokens_left", "mark_us", "before", "by", "low", "high", "requests", "first", "held_tokens", "held_mark"]
KINDS = "at_us bigint, allowed boolean, tokens_left bigint, mark_us bigint, before bigint, by bigint, low bigint, high bigint, requests bigint, first bigint, held_tokens bigint, held_mark bigint"


def _rows(kind: int, slice_: int, clients: pa.Array, ids: pa.Array, **values) -> pa.RecordBatch:
    n = len(clients)
    columns = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, slice_, np.int32)), clients, ids]
    columns += [pa.array(values[c]) if c in values else pa.nulls(n, pa.bool_() if c == "allowed" else pa.int64()) for c in COLUMNS]
    return pa.RecordBatch.from_arrays(columns, ["kind", "slice", "client", "event_id", *COLUMNS])


def _first_pass(rule: _Rule):
    """Sorted requests of one slice: decisions, open rows and their table, and the bucket of the last client."""

    def table_rows(slice_, client, stretch: Stretch, held) -> pa.RecordBatch:
        n = len(stretch.at)
        same = lambda x: np.full(n, x, np.int64)
        own = {"at_us": stretch.at, "mark_us": stretch.mark, "before": stretch.before, "by": stretch.shift.by, "low": stretch.shift.low, "high": stretch.shift.high}
        kept = {c: pa.array([x] * n, pa.int64()) for c, x in zip(("held_tokens", "held_mark"), held)}
        return _rows(TABLE, slice_, pa.repeat(client, n), pa.nulls(n, pa.int64()), **own, **kept, requests=same(stretch.requests), first=same(stretch.first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slice_ = TaskContext.get().partitionId()
        head = client = state = None  # the open client's stretch; the last client and its bucket
        held, begun = (None, None), False
        for batch in batches:
            if not len(batch):
                continue
            clients, ids = batch.column("client"), batch.column("event_id")
            t = batch.column("at_us").to_numpy()
            code = clients.dictionary_encode(null_encoding="encode").indices.to_numpy()
            heads = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            goes_on = begun and clients[0].as_py() == client.as_py()
            if not begun:
                held = (batch.column("held_tokens")[0].as_py(), batch.column("held_mark")[0].as_py())
            start = 0
            if not begun or (head is not None and goes_on):
                # The first client of the slice may have begun in an earlier one.
                start = int(heads[1]) if len(heads) > 1 else len(t)
                own = Stretch.of(t[:start], *rule.args())
                head = own if head is None else head.followed(own, *rule.args())
                yield _rows(OPEN, slice_, clients.slice(0, start), ids.slice(0, start), at_us=t[:start])
                if not begun:
                    client, begun = clients[0], True
            if head is not None and start < len(t):
                yield table_rows(slice_, client, head, held)
                head = None
                goes_on = False
            if start < len(t):
                own = heads[heads >= start] - start
                first = heads[heads >= start]
                tokens = batch.column("held_tokens").fill_null(rule.burst).to_numpy()[first]
                marks = np.where(batch.column("held_mark").is_null().to_numpy(zero_copy_only=False)[first], t[first], batch.column("held_mark").fill_null(0).to_numpy()[first])
                if goes_on:
                    tokens, marks = tokens.copy(), marks.copy()
                    tokens[0], marks[0] = state
                allowed, left, mark = rule.decided(t[start:], own, tokens, marks)
                yield _rows(DECIDED, slice_, clients.slice(start), ids.slice(start), at_us=t[start:], allowed=allowed, tokens_left=left, mark_us=mark)
                client, state = clients[len(t) - 1], (int(left[-1]), int(mark[-1]))
        if head is not None:
            yield table_rows(slice_, client, head, held)
        elif begun:
            yield _rows(TAIL, slice_, pa.repeat(client, 1), pa.nulls(1, pa.int64()), held_tokens=np.array([state[0]]), held_mark=np.array([state[1]]))

    return run


def _stretch(rows: pd.DataFrame) -> Stretch:
    whole = {c: rows[c].to_numpy().astype(np.int64) for c in ("at_us", "before", "mark_us", "by", "low", "high")}
    shift = Shift(whole["by"], whole["low"], whole["high"])
    return Stretch(whole["at_us"], whole["before"], whole["mark_us"], shift, int(rows["requests"].iloc[0]), int(rows["first"].iloc[0]))


def _joined(rule: _Rule):
    """Tables of some neighbouring blocks to one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "at_us", "before"], ignore_index=True)
        whole = None
        for _, own in rows.groupby("block", sort=True):
            own = _stretch(own)
            whole = own if whole is None else whole.followed(own, *rule.args())
        first = rows.iloc[0]
        return pd.DataFrame({
            "client": pd.Series([first["client"]] * len(whole.at), dtype=object), "block": first["block"] // TOGETHER, "at_us": whole.at, "before": whole.before, "mark_us": whole.mark,
            "by": whole.shift.by, "low": whole.shift.low, "high": whole.shift.high, "requests": whole.requests, "first": whole.first,
            "held_tokens": first["held_tokens"], "held_mark": first["held_mark"],
        })

    return run


def _walked(rule: _Rule):
    """Tables of neighbouring blocks, and the bucket before them if there is one, to the bucket before each."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        given = rows[rows["requests"].isna()]
        tables = rows[rows["requests"].notna()].sort_values(["block", "at_us", "before"])
        if not len(tables):
            return pd.DataFrame({"client": pd.Series([], dtype=object), "block": [], "tokens": [], "mark": []})
        first = tables.iloc[0]
        if len(given):
            tokens, mark = int(given["held_tokens"].iloc[0]), int(given["held_mark"].iloc[0])
        elif pd.isna(first["held_tokens"]):
            tokens, mark = rule.burst, int(first["first"])
        else:
            tokens, mark = int(first["held_tokens"]), int(first["held_mark"])
        out = []
        for block, own in tables.groupby("block", sort=True):
            out.append((first["client"], block, tokens, mark))
            tokens, mark = _stretch(own).applied(tokens, mark, *rule.args())
        return pd.DataFrame(out, columns=["client", "block", "tokens", "mark"]).astype({"client": object})

    return run


def _states(tables: DataFrame, starts: DataFrame, rule: _Rule, blocks: int) -> DataFrame:
    """(client, block, tokens, mark): the bucket before each block; ``starts`` are like tables without requests."""
    kind = dict(tables.dtypes)["client"]
    states = f"client {kind}, block bigint, tokens bigint, mark bigint"
    if blocks <= TOGETHER:
        return tables.unionByName(starts).groupBy("client").applyInPandas(_walked(rule), states)
    parent = F.floor(F.col("block") / TOGETHER)
    larger = tables.groupBy("client", parent).applyInPandas(_joined(rule), tables.schema)
    above = _states(larger, starts, rule, -(-blocks // TOGETHER))
    entering = above.select("client", (F.col("block") * TOGETHER).alias("block"), F.col("tokens").alias("held_tokens"), F.col("mark").alias("held_mark"))
    both = tables.unionByName(entering, allowMissingColumns=True)
    return both.groupBy("client", parent).applyInPandas(_walked(rule), states)


def _second_pass(rule: _Rule):
    """Open rows by slice, in order, each slice with its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            if not len(batch):
                continue
            t, slices = batch.column("at_us").to_numpy(), batch.column("slice").to_numpy()
            heads = np.flatnonzero(np.concatenate([[True], slices[1:] != slices[:-1]]))
            tokens, marks = (batch.column(c).to_numpy()[heads].copy() for c in ("tokens", "mark"))
            if slices[0] == at:
                tokens[0], marks[0] = state
            allowed, left, mark = rule.decided(t, heads, tokens, marks)
            at, state = slices[-1], (int(left[-1]), int(mark[-1]))
            columns = [batch.column(c) for c in ("client", "event_id", "at_us")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(allowed), pa.array(left), pa.array(mark)], ["client", "event_id", "at_us", "allowed", "tokens_left", "mark_us"])

    return run


def token_buckets(requests: DataFrame, rate: float, burst: int, buckets: DataFrame | None = None, slices: int | None = None) -> DataFrame:
    """Every request of (client, ts, event_id: bigint) with its decision and its client's bucket after it.

    Adds ``at_us``, ``allowed``, ``tokens_left`` and ``mark_us``, the time the
    last refill counts from. ``buckets`` (client, tokens_left, mark_us) continues
    from earlier requests; other clients start full. Requests of a client go in
    order of (ts, event_id), over as many slices as they take; what slices hand
    on grows with the requests within one refill pause, not with the client.
    """
    rule = _Rule(rate, burst)
    spark = requests.sparkSession
    none = F.lit(None).cast("bigint")
    timed = requests.select("client", F.col("event_id").cast("bigint").alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    if buckets is None:
        timed = timed.withColumns({"held_tokens": none, "held_mark": none})
    else:
        held = buckets.select(F.col("client").alias("__held"), F.col("tokens_left").alias("held_tokens"), F.col("mark_us").alias("held_mark"))
        timed = timed.join(held, F.col("client").eqNullSafe(F.col("__held")), "left").drop("__held")
    along = ["client", "at_us", "event_id"]
    parts = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = timed.repartitionByRange(parts, *[F.col(c) for c in along]).sortWithinPartitions(*along)
    kind = dict(timed.dtypes)["client"]
    first = settled(laid.mapInArrow(_first_pass(rule), f"kind int, slice int, client {kind}, event_id bigint, {KINDS}"), "buckets")

    block = F.col("slice").cast("bigint").alias("block")
    summary = first.select("kind", "client", block, "at_us", "before", "mark_us", "by", "low", "high", "requests", "first", "held_tokens", "held_mark")
    tables, tails = (summary.filter(F.col("kind") == k).drop("kind") for k in (TABLE, TAIL))
    states = _states(tables, tails, rule, parts)
    # One row per slice.
    entering = F.broadcast(states.select(F.col("block").cast("int").alias("slice"), "tokens", "mark"))
    opened = first.filter(F.col("kind") == OPEN).join(entering, "slice").select("slice", "client", "event_id", "at_us", "tokens", "mark")
    sorted_rows = opened.repartitionByRange(parts, "slice").sortWithinPartitions("slice", "at_us", "event_id")
    out = "client, event_id, at_us, allowed, tokens_left, mark_us".split(", ")
    late = sorted_rows.mapInArrow(_second_pass(rule), f"client {kind}, event_id bigint, at_us bigint, allowed boolean, tokens_left bigint, mark_us bigint")
    return first.filter(F.col("kind") == DECIDED).select(*out).unionByName(late)
