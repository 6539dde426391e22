"""Penalised change points of daily series: an ordered table function per key, fed with one aggregated day after the other."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table

SEGMENTS = "segment_no int, first_day long, n_days long, total long, spread long, cost long, n_segments long, best_cost long"
_FAR = np.int64(1) << 61


def spread_of(n: int, s: int, q: int) -> int:
    """1 + floor of the variance of n values with sum s and sum of squares q, in exact integers."""
    return 1 + (n * q - s * s) // (n * n)


def cost_of(n: int, spread: int) -> int:
    """n times floor(1000 ln spread)."""
    return n * math.floor(1000 * math.log(spread))


def log_steps(spreads: np.ndarray) -> np.ndarray:
    """floor(1000 ln v) of an array of integers from 1, as math.log gives it: where the array logarithm comes near a whole number, that one decides."""
    if spreads.dtype == object:
        return np.array([math.floor(1000 * math.log(v)) for v in spreads.ravel()], dtype=np.int64).reshape(spreads.shape)
    x = 1000 * np.log(spreads)
    down = np.floor(x)
    close = (np.abs(x - np.rint(x)) < 1e-6) & (spreads > 1)
    if close.any():
        down[close] = [math.floor(1000 * math.log(v)) for v in spreads[close].tolist()]
    return down.astype(np.int64)


class Series:
    """The cheapest cut of a series into segments of at least least days, found while its days come in.

    A start is live once all days before it can be cut, that is at the first day and from day number least on. For each live
    start the sum and the sum of squares from it to the newest day are kept as integers and extended by each day. Days
    are taken in blocks of least: a segment that ends in a block begins before it or with it, so all that its start has to
    know is settled, and a block is a few array operations over live starts x days. No start is ever given up: rounding
    down makes costs of joined segments fall short of their parts' sum, so the usual pruning could lose the best cut. With n
    days this takes n * n / 2 costs and memory in proportion to n."""

    def __init__(self, least: int, penalty: int):
        self.least, self.penalty = least, penalty
        self.first: int | None = None
        self.block: list[int] = []
        self.sums, self.squares = [0], [0]  # of the first so many days
        self.best, self.count, self.last = [0], [0], [0]  # of the first so many days: cost, segments, where the last one starts
        # of live starts: where they are, sums and squares to the newest day, and the cost and segments of all before
        self.starts, self.s, self.q, self.before, self.counts = (np.zeros(0, np.int64) for _ in range(5))

    def add(self, day: int, value: int) -> None:
        """The next day with rows; days left out before it count 0."""
        if self.first is None:
            self.first = self.at = day
        while self.at < day:
            self._take(0)
        self._take(value)

    def _take(self, value: int) -> None:
        self.block.append(value)
        self.at += 1
        if len(self.block) == self.least:
            self._extend()

    def _extend(self) -> None:
        days, done = self.block, len(self.best) - 1
        self.block = []
        for x in days:
            self.sums.append(self.sums[-1] + x)
            self.squares.append(self.squares[-1] + x * x)
        if self.s.dtype != object and (done + len(days)) * self.squares[-1] >= 1 << 62:
            self.s, self.q = self.s.astype(object), self.q.astype(object)
        kind = self.s.dtype
        run, runq = np.array([x - self.sums[done] for x in self.sums[done + 1 :]], kind), np.array([x - self.squares[done] for x in self.squares[done + 1 :]], kind)
        self._open(done, np.zeros(1, kind), np.zeros(1, kind))  # blocks are full but for the last one: done is 0, or least or more
        n = np.arange(done + 1, done + len(days) + 1)[None, :] - self.starts[:, None]
        s, q = self.s[:, None] + run, self.q[:, None] + runq
        total = n * log_steps((n * q - s * s) // (n * n) + 1) + self.before[:, None]
        total[n < self.least] = _FAR
        first = np.where(total == total.min(axis=0), self.counts[:, None], _FAR).argmin(axis=0)  # of equal ones the first, that is the earliest start
        self.best += total[first, np.arange(len(days))].tolist()
        self.count += (self.counts[first] + 1).tolist()
        self.last += self.starts[first].tolist()
        self.s, self.q = self.s + run[-1], self.q + runq[-1]
        skip = max(0, self.least - done - 1)  # of the starts inside the block
        self._open(done + 1 + skip, run[-1] - run[skip:-1], runq[-1] - runq[skip:-1])

    def _open(self, low: int, s: np.ndarray, q: np.ndarray) -> None:
        """The starts from low on become live; s and q: their sums so far."""
        high = low + len(s)
        more = np.arange(low, high), s, q, np.array(self.best[low:high], np.int64) + self.penalty * (low > 0), np.array(self.count[low:high], np.int64)
        held = self.starts, self.s, self.q, self.before, self.counts
        self.starts, self.s, self.q, self.before, self.counts = (np.concatenate(x) for x in zip(held, more, strict=True))

    def segments(self) -> list[tuple[int, int, int, int, int, int, int, int]]:
        """The segments in order, as SEGMENTS names them; of a series without days none, and of one shorter than least days one."""
        if self.first is None:
            return []
        if self.block:
            self._extend()
        n, cuts = len(self.best) - 1, []
        end = n
        while end > 0:
            start = self.last[end] if n >= self.least else 0
            cuts.append((start, end))
            end = start
        out = []
        for at, (start, end) in enumerate(reversed(cuts), 1):
            s, q = self.sums[end] - self.sums[start], self.squares[end] - self.squares[start]
            v = spread_of(end - start, s, q)
            out.append((at, self.first + start, end - start, s, v, cost_of(end - start, v)))
        whole = sum(x[5] for x in out) + self.penalty * (len(out) - 1)
        return [(*x, len(out), whole) for x in out]


def segmenter(key_type: str, least: int, penalty: int):
    """A table function over (key, day, total), dealt by key and ordered by day, that yields key and SEGMENTS of each key.

    Spark hands each key its days as slices of Arrow batches; the worker's time a row is then a tenth of what rows one by one take."""

    class Segmenter:
        def __init__(self) -> None:
            self.series, self.key = Series(least, penalty), None

        def eval(self, days: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            self.key = days.column(0)[:1]
            for day, total in zip(days.column(1).to_pylist(), days.column(2).to_pylist(), strict=True):
                self.series.add(day, int(total))
            return iter(())

        def terminate(self) -> Iterator[pa.RecordBatch]:
            if found := self.series.segments():
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), [pa.int32(), *[pa.int64()] * 7], strict=True)]
                yield pa.RecordBatch.from_arrays([self.key.take(pa.array([0] * len(found))), *columns], names=["key", *(x.split()[0] for x in SEGMENTS.split(", "))])

    return F.arrow_udtf(Segmenter, returnType=f"key {key_type}, {SEGMENTS}")


def daily_totals(rows: DataFrame, key: str, value: str, when: str) -> DataFrame:
    """(key, day, total): sums of an integer column by key and day, days counted since 1970. Rows without value or time don't count; a null key is one of its own."""
    kind = dict(rows.dtypes)[value]
    if kind not in ("tinyint", "smallint", "int", "bigint") and not (kind.startswith("decimal") and kind.endswith(",0)")):
        raise ValueError(f"{value} is {kind}; whole numbers are asked for")
    v = F.col(f"`{value}`").cast("long" if kind in ("tinyint", "smallint", "int") else "decimal(38,0)")
    taken = rows.select(F.col(f"`{key}`").alias("key"), F.unix_date(F.col(f"`{when}`").cast("date")).cast("long").alias("day"), v.alias("value"))
    return taken.filter("value is not null and day is not null").groupBy("key", "day").agg(F.sum("value").alias("total"))


def change_points(rows: DataFrame, key: str = "vendor_id", value: str = "quantity", when: str = "shipped_at", least: int = 14, penalty: int = 40_000) -> DataFrame:
    """The cheapest segments of each key's daily series: key, segment_no, first_day, n_days, total, spread, cost, n_segments, best_cost.

    A series runs from the key's first to its last day with rows that have value and time; days between without any count 0,
    repeated rows count each. It is cut into segments of least days or more (a shorter series is one segment) such that
    the costs' sum plus penalty a cut is smallest; ties go to fewer segments, then to earlier starts from the last segment
    backwards. Rows are summed by key and day first, combined before they move, so that a key of any number of rows
    sends one row a day to the table function, which holds one key's days at a time. Sums are exact; one that a long can't hold is an error, never a
    wrong number. A null key is a series of its own; other columns are not read; no rows, no segments."""
    if least < 1:
        raise ValueError("a segment has one day at least")
    days = daily_totals(rows, key, value, when)
    kind = days.schema["key"].dataType.simpleString()
    found = segmenter(kind, least, penalty)(days.asTable().partitionBy("key").orderBy("day"))
    return found.withColumnRenamed("key", key)


def op11_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of every vendor's daily quantities."""
    return change_points(table(spark, sf_dir, "sale_lines"))


_COST = "({b} - {a}) * CAST(floor(1000 * ln(CAST(1 + (({b} - {a}) * (pq[{b} + 1] - pq[{a} + 1]) - (ps[{b} + 1] - ps[{a} + 1]) * (ps[{b} + 1] - ps[{a} + 1])) // (({b} - {a}) * ({b} - {a})) AS DOUBLE))) AS BIGINT)"

ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT vendor_id, date_diff('day', DATE '1970-01-01', CAST(shipped_at AS DATE)) AS day, CAST(sum(quantity) AS HUGEINT) AS x
  FROM sale_lines WHERE quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY ALL
), spans AS (
  SELECT vendor_id, unnest(range(min(day), max(day) + 1)) AS day FROM d GROUP BY vendor_id
), sums AS (
  SELECT s.vendor_id, s.day, sum(coalesce(x, 0)) OVER w AS s, sum(coalesce(x, 0) * coalesce(x, 0)) OVER w AS q
  FROM spans s LEFT JOIN d ON s.vendor_id IS NOT DISTINCT FROM d.vendor_id AND s.day = d.day WINDOW w AS (PARTITION BY s.vendor_id ORDER BY s.day)
), pre AS (
  SELECT vendor_id, min(day) AS first, count(*) AS n, list_prepend(0::HUGEINT, list(s::HUGEINT ORDER BY day)) AS ps, list_prepend(0::HUGEINT, list(q::HUGEINT ORDER BY day)) AS pq FROM sums GROUP BY vendor_id
), dp AS (
  SELECT vendor_id, 0::BIGINT AS t, n, ps, pq, [{{'c': 0::BIGINT, 'k': 0::BIGINT, 's': 0::BIGINT}}] AS best FROM pre
  UNION ALL
  SELECT vendor_id, t + 1, n, ps, pq, list_append(best, CASE WHEN t + 1 < 14 AND n >= 14 THEN NULL ELSE list_min(list_transform(
    list_filter(range(0, greatest(t + 1 - 13, 1)), lambda s: s = 0 OR s >= 14),
    lambda s: {{'c': best[s + 1].c + CASE WHEN s > 0 THEN 40000 ELSE 0 END + CAST({_COST.format(a='s', b='(t + 1)')} AS BIGINT), 'k': best[s + 1].k + 1, 's': s}})) END)
  FROM dp WHERE t < n
), done AS (
  SELECT vendor_id, n, ps, pq, best FROM dp WHERE t = n
), cuts AS (
  SELECT vendor_id, best, n AS e, best[n + 1].s AS s FROM done
  UNION ALL
  SELECT vendor_id, best, s, best[s + 1].s FROM cuts WHERE s > 0
)
SELECT c.vendor_id, CAST(row_number() OVER (PARTITION BY c.vendor_id ORDER BY s) AS INTEGER) AS segment_no, pre.first + s AS first_day, e - s AS n_days, CAST(ps[e + 1] - ps[s + 1] AS BIGINT) AS total,
  CAST(1 + ((e - s) * (pq[e + 1] - pq[s + 1]) - (ps[e + 1] - ps[s + 1]) * (ps[e + 1] - ps[s + 1])) // ((e - s) * (e - s)) AS BIGINT) AS spread,
  CAST({_COST.format(a='s', b='e')} AS BIGINT) AS cost, best[n + 1].k AS n_segments, best[n + 1].c AS best_cost
FROM cuts c JOIN pre ON c.vendor_id IS NOT DISTINCT FROM pre.vendor_id
"""
