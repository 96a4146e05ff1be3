"""Ordered funnels by a forward sweep.

1. Rows become one per client and time, with the set of kinds that it holds, and are dealt out by ranges of (client, time).
   A client with any share of the rows is cut into as many ranges as it fills; no task holds more than others.
2. Each task sweeps its rows once. Attempts that wait for the same step of a funnel stand in one deque, oldest first. A row
   of the step's kind moves all of them on at once, as one entry that counts them; a row of the excluded kind clears
   them; those that have waited too long leave at the deque's old end.
3. Where a range ends inside a client, waiting attempts go on in later ranges. What such a range does to newcomers is
   known from few numbers: the first time of each kind in it, and how an attempt goes on that arrives there at a step.
   Both are kept for the first client of each range, and the attempts that wait at ends of ranges are joined with them,
   once for each step that is left.
4. Quantiles of step times are found by digits of the time, highest first, so that a client's times never meet in one task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored

#: Name, kinds of the steps, excluded kind.
FUNNELS = [
    ("A", ["view", "click", "view", "purchase"], "error"),
    ("B", ["signup", "view", "click", "purchase"], "error"),
    ("C", ["click", "click", "purchase", "view"], "signup"),
]
#: Microseconds that an attempt may wait for its next step.
LIMIT = 3_600_000_000
#: Bits of a step time that are settled by each pass of the search for a quantile, highest first; a group then has 2,048 rows at most.
DIGITS = [21, 10, 0]
STEP, PENDING, HEAD, CHAIN = range(4)
_ROW = "what int, client long, funnel int, step int, t long, n long, last long, path array<long>, end_step int, end_t long"
_NAMES = [c.strip().split()[0] for c in _ROW.split(",")]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64()]


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else [()] * len(_NAMES)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


class _Newcomer:
    """How an attempt goes on in a range if it reaches ``step`` of ``funnel`` at the range's first row of that step's kind."""

    def __init__(self, funnel: int, step: int, kinds: list[int], excluded: int):
        self.funnel, self.step, self.kinds, self.excluded = funnel, step, kinds, excluded
        self.at: int | None = None
        self.now, self.since, self.path, self.alive = step, 0, [], True

    def see(self, t: int, mask: int, limit: int) -> bool:
        """Takes the next row; False once nothing can change any more."""
        if self.at is None:
            if mask >> self.kinds[self.step - 1] & 1:
                self.at = self.since = t
            return True
        if t - self.since > limit or mask >> self.excluded & 1:
            self.alive = False
        elif mask >> self.kinds[self.now] & 1:
            self.path.append(t - self.since)
            self.now, self.since = self.now + 1, t
            self.alive = self.now < len(self.kinds)
        return self.alive


class _Sweep:
    """The state machine over sorted rows (client, time, kinds) of one range."""

    def __init__(self, funnels: list[tuple[list[int], int]], n_kinds: int, limit: int):
        self.funnels, self.n_kinds, self.limit = funnels, n_kinds, limit
        self.moves = [self._moves(mask) for mask in range(1 << n_kinds)]
        self.waiting = [[deque() for _ in kinds] for kinds, _ in funnels]
        self.started = [0] * len(funnels)
        self.client: int | None = None
        self.last = 0
        self.out: list[tuple] = []
        # Of the first client alone: first times by kind, newcomers, and those of them that still change.
        self.head: tuple[int, int] | None = None
        self.first: dict[int, int] = {}
        self.newcomers = [_Newcomer(f, j, kinds, excluded) for f, (kinds, excluded) in enumerate(funnels) for j in range(2, len(kinds))]
        self.open = list(self.newcomers)

    def _moves(self, mask: int) -> list[tuple[int, bool, list[int], bool]]:
        """For each funnel that a row of these kinds concerns: does it clear, which steps' attempts move on (last steps first, so that none moves twice), does one begin."""
        found = []
        for f, (kinds, excluded) in enumerate(self.funnels):
            clears, begins = bool(mask >> excluded & 1), bool(mask >> kinds[0] & 1)
            steps = [] if clears else [k for k in range(len(kinds) - 1, 0, -1) if mask >> kinds[k] & 1]
            if clears or steps or begins:
                found.append((f, clears, steps, begins))
        return found

    def row(self, client: int, t: int, mask: int) -> None:
        if client != self.client:
            self._close_client()
            if self.client is None:
                self.head = (client, t)
            else:
                self._close_head()
            self.client = client
        self.last = t
        if self.head:
            self._watch(t, mask)
        limit, out = self.limit, self.out
        for f, clears, steps, begins in self.moves[mask]:
            waiting = self.waiting[f]
            if clears:
                for q in waiting:
                    q.clear()
            for k in steps:
                q = waiting[k]
                self._expire(q, t)
                if q:
                    total = 0
                    for since, n in q:
                        out.append((STEP, client, f, k + 1, t - since, n, None, None, None, None))
                        total += n
                    q.clear()
                    if k + 1 < len(waiting):
                        waiting[k + 1].append((t, total))
            if begins:
                q = waiting[1]
                if q and t - q[0][0] > limit:
                    self._expire(q, t)
                q.append((t, 1))
                self.started[f] += 1

    def _expire(self, q: deque, t: int) -> None:
        while q and t - q[0][0] > self.limit:
            q.popleft()

    def _watch(self, t: int, mask: int) -> None:
        if len(self.first) < self.n_kinds:
            for kind in range(self.n_kinds):
                if mask >> kind & 1:
                    self.first.setdefault(kind, t)
        if self.open:
            self.open = [x for x in self.open if x.see(t, mask, self.limit)]

    def _close_client(self) -> None:
        for f, n in enumerate(self.started):
            if n:
                self.out.append((STEP, self.client, f, 1, None, n, None, None, None, None))
        self.started = [0] * len(self.funnels)
        for waiting in self.waiting:
            for q in waiting:
                q.clear()

    def _close_head(self) -> None:
        """What the range does to attempts of its first client that come from before it. Steps of a HEAD row: the kind."""
        if not self.head:
            return
        client, begin = self.head
        for kind, t in self.first.items():
            self.out.append((HEAD, client, None, kind, t, None, begin, None, None, None))
        for x in self.newcomers:
            if x.at is not None:
                waits = x.alive and self.last - x.since <= self.limit
                self.out.append((CHAIN, client, x.funnel, x.step, x.at, None, self.last, x.path, x.now if waits else None, x.since if waits else None))
        self.head = None

    def close(self) -> None:
        if self.client is None:
            return
        self._close_head()
        for f, waiting in enumerate(self.waiting):
            for k, q in enumerate(waiting):
                self._expire(q, self.last)
                self.out += [(PENDING, self.client, f, k, t, n, self.last, None, None, None) for t, n in q]
        self._close_client()


def _swept(funnels: list[tuple[list[int], int]], n_kinds: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = _Sweep(funnels, n_kinds, limit)
        for batch in batches:
            times = batch.column(1)
            if not pa.types.is_int64(times.type):
                times = times.cast(pa.timestamp("us", times.type.tz)).cast(pa.int64())
            for row in zip(batch.column(0).to_pylist(), times.to_pylist(), batch.column(2).to_pylist(), strict=True):
                sweep.row(*row)
            if sweep.out:
                yield _rows(sweep.out)
                sweep.out = []
        sweep.close()
        yield _rows(sweep.out)

    return run


def _next_in_later_ranges(swept: DataFrame, n_kinds: int, limit: int) -> DataFrame:
    """client, last, x0, x1, ...: for each end of a range inside a client, the first time of each kind in the client's later ranges, as far as it can matter.

    An attempt waits for ``limit`` at most, so what it may meet is in a range that begins in the end's slot of that length
    or in the next one: ranges are brought together by client and slot, not by client.
    """
    kinds = F.explode(F.sequence(F.lit(0), F.lit(n_kinds - 1)))
    ends = swept.where(F.col("what") == PENDING).select("client", "last")
    ends = ends.union(swept.where((F.col("what") == CHAIN) & F.col("end_step").isNotNull()).select("client", "last")).distinct()
    slot = F.expr(f"last div {limit}")
    heads = swept.where(F.col("what") == HEAD).select("client", F.explode(F.array(slot, slot - 1)).alias("slot"), F.col("last").alias("pos"), F.col("step").alias("kind"), F.col("t").alias("x"), F.lit(0).alias("end"))
    marks = heads.unionByName(ends.select("client", slot.alias("slot"), F.col("last").alias("pos"), kinds.alias("kind"), F.lit(None).cast("long").alias("x"), F.lit(1).alias("end")))
    later = Window.partitionBy("client", "slot", "kind").orderBy(F.desc("pos"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    found = marks.withColumn("next", F.min("x").over(later)).where((F.col("end") == 1) & F.col("next").isNotNull())
    return found.groupBy("client", F.col("pos").alias("last")).agg(*[F.min(F.when(F.col("kind") == k, F.col("next"))).alias(f"x{k}") for k in range(n_kinds)])


def _carried(swept: DataFrame, funnels: list[tuple[list[int], int]], n_kinds: int, limit: int) -> DataFrame:
    """client, funnel, step, d, n: the steps that attempts reach in a later range than that of the step before."""
    pending = swept.where(F.col("what") == PENDING).select("client", "funnel", "step", "t", "n", "last")
    found = None
    if pending.limit(1).count():
        later = stored(_next_in_later_ranges(swept, n_kinds, limit), "funnel-later")
        chains = swept.where(F.col("what") == CHAIN).select("client", "funnel", "step", F.col("t").alias("at"), "path", "end_step", "end_t", F.col("last").alias("end_last"))
        for _ in range(max(len(kinds) for kinds, _ in funnels) - 1):
            x = F.coalesce(*[F.when((F.col("funnel") == f) & (F.col("step") == k), F.col(f"x{kinds[k]}")) for f, (kinds, _) in enumerate(funnels) for k in range(1, len(kinds))])
            out = F.coalesce(*[F.when(F.col("funnel") == f, F.col(f"x{excluded}")) for f, (_, excluded) in enumerate(funnels)])
            at = (pending.join(later, ["client", "last"]).select("client", "funnel", (F.col("step") + 1).alias("step"), "t", "n", x.alias("at"), out.alias("out"))
                  .where((F.col("at") - F.col("t") <= limit) & (F.col("out").isNull() | (F.col("out") > F.col("at")))))
            reached = at.select("client", "funnel", "step", (F.col("at") - F.col("t")).alias("d"), "n")
            arrived = at.groupBy("client", "funnel", "step", "at").agg(F.sum("n").alias("n")).join(chains, ["client", "funnel", "step", "at"])
            onward = arrived.select("client", "funnel", "step", "n", F.posexplode("path").alias("pos", "d")).select("client", "funnel", (F.col("step") + F.col("pos") + 1).alias("step"), "d", "n")
            steps = reached.unionByName(onward)
            found = steps if found is None else found.unionByName(steps)
            pending = stored(arrived.where("end_step is not null").select("client", "funnel", F.col("end_step").alias("step"), F.col("end_t").alias("t"), "n", F.col("end_last").alias("last")), "funnel-pending")
    if found is None:
        return swept.sparkSession.createDataFrame([], "client long, funnel int, step int, d long, n long")
    return stored(found, "funnel-carried")


def weighted_quantile(values: DataFrame, keys: list[str], value: str, weight: str, num: int, den: int, digits: list[int] | None = None) -> DataFrame:
    """keys, ``value``: the ceil(num * n / den)-th smallest of the n values of each group, each row counting ``weight`` times.

    Values are whole, from 0 on. Each pass sums weights by the value's next digit, finds the digit in which the rank lies and
    keeps its rows alone: no group is gathered, a window holds one row per digit.
    """
    w = Window.partitionBy(*keys).orderBy("_digit")
    at: DataFrame | None = None
    for shift in digits or DIGITS:
        rows = values.withColumn("_digit", F.shiftright(value, shift))
        if at is not None:
            rows = rows.withColumn("_high", F.shiftright(value, above)).join(at, [*keys, "_high"]).drop("_high")
        else:
            rows = rows.withColumn("_rank", F.lit(None).cast("long"))
        sums = rows.groupBy(*keys, "_digit").agg(F.sum(weight).alias("_n"), F.first("_rank").alias("_rank"))
        sums = sums.withColumn("_to", F.sum("_n").over(w)).withColumn("_rank", F.coalesce("_rank", F.expr(f"({num} * sum(_n) over (partition by {', '.join(keys)}) + {den - 1}) div {den}")))
        at = sums.where((F.col("_to") >= F.col("_rank")) & (F.col("_to") - F.col("_n") < F.col("_rank"))).select(*keys, F.col("_digit").alias("_high"), (F.col("_rank") - F.col("_to") + F.col("_n")).alias("_rank"))
        above = shift
    return at.select(*keys, F.col("_high").alias(value))


def _kinds(funnels) -> list[str]:
    return sorted({k for _, kinds, excluded in funnels for k in (*kinds, excluded)})


def _mask(kinds: list[str]) -> Column:
    return F.bit_or(F.coalesce(*[F.when(F.col("kind") == k, F.lit(1 << i)) for i, k in enumerate(kinds)]))


def steps_of(clicks: DataFrame, funnels=FUNNELS, limit: int = LIMIT, key: str = "client_id", kind: str = "kind", ts: str = "ts") -> DataFrame:
    """client, funnel (its place in ``funnels``), step from 1, d, n: how many attempts reached the step ``d`` microseconds after the one before (null for the first). Rows of equal step and time may repeat."""
    kinds = _kinds(funnels)
    number = {k: i for i, k in enumerate(kinds)}
    coded = [([number[k] for k in steps], number[excluded]) for _, steps, excluded in funnels]
    rows = clicks.select(F.col(key).cast("long").alias("client"), F.col(ts).alias("ts"), F.col(kind).alias("kind")).where(F.col("kind").isin(kinds) & F.col("client").isNotNull() & F.col("ts").isNotNull())
    times = rows.groupBy("client", "ts").agg(_mask(kinds).alias("mask"))
    swept = stored(times.repartitionByRange("client", "ts").sortWithinPartitions("client", "ts").mapInArrow(_swept(coded, len(kinds), limit), _ROW), "funnel-swept")
    own = swept.where(F.col("what") == STEP).select("client", "funnel", "step", F.col("t").alias("d"), "n")
    return own.unionByName(_carried(swept, coded, len(kinds), limit))


def funnel_report(clicks: DataFrame, funnels=FUNNELS, limit: int = LIMIT, key: str = "client_id", kind: str = "kind", ts: str = "ts") -> DataFrame:
    """funnel, client, n1.., deepest, t2.., same_depth of each funnel and client with attempts.

    Rows with a null client, kind or time are left out, equal ones count once, kinds of no funnel don't matter. Every row
    of the first step's kind begins an attempt. The next step is the client's first later row of its kind, at most ``limit``
    microseconds on, with no excluded row after the step before and up to it. Of rows with one time none is later than
    another. No rows: no result rows. All funnels have the same number of steps, two or more; other columns aren't read.
    """
    last = {len(steps) for _, steps, _ in funnels}
    if len(last) != 1 or min(last) < 2:
        raise ValueError("funnels need the same number of steps, two at least")
    depth = last.pop()
    steps = steps_of(clicks, funnels, limit, key, kind, ts)
    counts = steps.groupBy("funnel", "client").agg(*[F.coalesce(F.sum(F.when(F.col("step") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(1, depth + 1)])
    deepest = F.coalesce(*[F.when(F.col(f"n{k}") > 0, F.lit(k)) for k in range(depth, 0, -1)])
    counts = counts.withColumn("deepest", deepest)
    late = weighted_quantile(steps.where("step > 1"), ["funnel", "client", "step"], "d", "n", 90, 100)
    late = late.groupBy("funnel", "client").agg(*[F.max(F.when(F.col("step") == k, F.col("d"))).alias(f"t{k}") for k in range(2, depth + 1)])
    out = stored(counts.join(late, ["funnel", "client"], "left"), "funnel-clients")
    # A row for each funnel and step.
    same = out.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth"))
    name = F.element_at(F.array(*[F.lit(n) for n, _, _ in funnels]), F.col("funnel") + 1)
    return out.join(F.broadcast(same), ["funnel", "deepest"]).select(name.alias("funnel"), F.col("client").alias(key), *[f"n{k}" for k in range(1, depth + 1)], "deepest", *[f"t{k}" for k in range(2, depth + 1)], "same_depth")


def op11_forward_sweep_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel_report(spark.read.parquet(f"{sf_dir}/clicks.parquet"))
