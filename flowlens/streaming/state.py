"""Stream forms of the ordered jobs: keyed state and timers.

Rows may come in any order as long as they are inside the watermark.  A processor
holds them until the watermark has passed them, then takes them in event order, so
its answers are those of the batch operator over all that is closed.  Keys are dealt
over a fixed number of buckets, and the rows of a bucket are held as Arrow batches and
taken as arrays: a call of the state store costs as much for a row as for a bucket.
What a bucket holds is bounded by the rows of the watermark's delay and by its rule;
timers free keys that have gone silent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlens.operators import detect as D
from flowlens.operators.sessions import ECHO_REPLY, ECHO_REQUEST

#: Arbitrary keyed state needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys share this many states; fixed, as a restarted query must find its keys again.
BUCKETS = 256
#: Stands for a null number in the arrays; sorts first, as null does.
NULL = -(1 << 63)


def use_keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(BUCKETS)).cast("int")


def _number(c: str) -> Column:
    return F.coalesce(F.col(c).cast("long"), F.lit(NULL))


def _ms(micros: int) -> int:
    return micros // 1000


def _pack(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(pa.Table.from_pandas(rows[schema.names], schema=schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpack(parts: list[bytes], schema: pa.Schema) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(bytes(p)).read_all() for p in parts]
    return (pa.concat_tables(tables) if tables else schema.empty_table()).to_pandas()


class _Ordered(StatefulProcessor):
    """Holds rows until the watermark is ``lag`` past them (column ``us``), then gives
    them to ``take``.  A timer stands at the oldest held row."""

    schema: pa.Schema
    lag = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        #: time of the oldest held row: a timer that finds nothing due reads no rows
        self.oldest = handle.getValueState("oldest", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, first = [], None
        for part in rows:
            if len(part):
                self.begin(part)
                new.append((_pack(part, self.schema),))
                low = int(part["us"].min())
                first = low if first is None else min(first, low)
        if new:
            self.held.appendList(new)
            if not self.oldest.exists() or first < self.oldest.get()[0]:
                self.oldest.update((first,))
            self.wake_at(first + self.lag)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        due, more = _unpack([], self.schema), self.oldest.exists()
        if more and self.oldest.get()[0] <= watermark - self.lag:
            rows = _unpack([r[0] for r in self.held.get()], self.schema)
            closed = rows["us"].to_numpy() <= watermark - self.lag
            due, rest = rows[closed], rows[~closed]
            more = len(rest) > 0
            if more:
                self.held.put([(_pack(rest, self.schema),)])
                self.oldest.update((int(rest["us"].min()),))
                self.wake_at(int(rest["us"].min()) + self.lag)
            else:
                self.held.clear()
                self.oldest.clear()
        out = self.take(key, due, watermark, more)
        if out is not None and len(out):
            yield out

    def wake_at(self, micros: int) -> None:
        """A timer fires once the watermark is past its time, so it stands just before the row's."""
        self.handle.registerTimer(_ms(micros) - 1)

    def close(self) -> None:
        pass

    def begin(self, part: pd.DataFrame) -> None:
        """Sees every new part."""

    def take(self, key, due: pd.DataFrame, watermark: int, more: bool) -> pd.DataFrame | None:
        raise NotImplementedError


class _Keyed(_Ordered):
    """A bucket of keys, each with one row of ``kept_schema`` that goes on from batch to batch."""

    kept_schema: pa.Schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getValueState("kept", "rows binary")

    def before(self) -> pd.DataFrame:
        return _unpack([self.kept.get()[0]] if self.kept.exists() else [], self.kept_schema)

    def keep(self, rows: pd.DataFrame, wake: int) -> None:
        """``wake`` is how long after its oldest row the bucket is looked through again."""
        if len(rows):
            self.kept.update((_pack(rows, self.kept_schema),))
            self.wake_at(int(rows["us"].min()) + wake + 1000)
        elif self.kept.exists():
            self.kept.clear()


def _fields(**types: str) -> pa.Schema:
    return pa.schema([(n, {"long": pa.int64(), "text": pa.string(), "flag": pa.bool_()}[t]) for n, t in types.items()])


class _PairHttp(_Keyed):
    """A request opens the connection's slot if it is empty, the next response closes it.
    A connection that is silent for longer than ``idle`` starts anew."""

    schema = _fields(key="text", us="long", seq="long", response="flag")
    #: the last row taken (us), whether it left the slot closed, and the open request, if any (seq, begun)
    kept_schema = _fields(key="text", us="long", seq="long", response="flag", begun="long")

    def __init__(self, idle_micros: int):
        self.idle = idle_micros

    def take(self, key, due: pd.DataFrame, watermark: int, more: bool) -> pd.DataFrame | None:
        old = self.before()
        rows = pd.concat([old, due.assign(begun=due["us"])], ignore_index=True)
        if not len(rows):
            return None
        code = rows.groupby("key", dropna=False, sort=False).ngroup().to_numpy()
        new = np.arange(len(rows)) >= len(old)
        order = np.lexsort((rows["response"], rows["seq"], rows["us"], new, code))
        rows, code = rows.iloc[order], code[order]
        us, seq, begun = (rows[c].to_numpy() for c in ("us", "seq", "begun"))
        response = rows["response"].to_numpy(bool)
        at = np.arange(len(rows))
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (code[1:] != code[:-1]) | (us[1:] - us[:-1] > self.idle)
        # a turn ends with a response; its first row, if not the response itself, is the request that opened the slot
        turn = fresh.copy()
        turn[1:] |= response[:-1]
        head = np.maximum.accumulate(np.where(turn, at, 0))
        last = np.append(code[1:] != code[:-1], True)
        # silent for long enough: a later row would start anew in any case
        left = np.nonzero(last & (watermark - us <= self.idle))[0]
        self.keep(pd.DataFrame({"key": rows["key"].to_numpy()[left], "us": us[left], "seq": seq[head[left]],
                                "response": response[left], "begun": begun[head[left]]}), self.idle)
        end = np.nonzero(response & (head != at))[0]
        return pd.DataFrame({"key": rows["key"].to_numpy()[end], "request_seq": seq[head[end]], "response_seq": seq[end],
                             "request_us": begun[head[end]], "response_us": us[end]})


def _micros(interval: str) -> int:
    return int(pd.Timedelta(interval.lower()) / pd.Timedelta(microseconds=1))


def stream_pair_http(events: DataFrame, key: str = "conn_id", delay: str = "10 minutes", idle: str = "1 hour") -> DataFrame:
    """``sessions.pair_http`` on a stream of (key, ts, seq, kind); the key is of a type that casts to text and back.

    Pairs appear once the watermark has passed their response.  Rows later than the
    watermark are dropped, as in every windowed job.  A connection that is silent for
    longer than ``idle`` loses its open request, whether or not a batch falls
    into the silence, and its state is freed by a timer.
    """
    use_keyed_state(events.sparkSession)
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).filter(F.col("ts").isNotNull())
    e = e.select("ts", _bucket(key).alias("bucket"), F.col(f"`{key}`").cast("string").alias("key"), F.unix_micros("ts").alias("us"),
                 _number("seq").alias("seq"), F.coalesce(F.col("kind") == "response", F.lit(False)).alias("response"))
    pairs = e.groupBy("bucket").transformWithStateInPandas(
        _PairHttp(_micros(idle)), "key string, request_seq long, response_seq long, request_us long, response_us long",
        "Append", "EventTime")
    return pairs.select(
        F.col("key").cast(events.schema[key].dataType).alias(key), *[F.nullif(c, F.lit(NULL)).alias(c) for c in ("request_seq", "response_seq")],
        F.timestamp_micros("request_us").alias("request_ts"), F.timestamp_micros("response_us").alias("response_ts"),
        F.greatest(F.floor((F.col("response_us") - F.col("request_us")) / 1000), F.lit(0)).cast("long").alias("latency_ms"))


class _Echo(_Keyed):
    """A reply whose event just before it, of the same key, is a request at most ``lag`` ago, is its answer."""

    KEYS = ["host", "echo_id", "echo_seq"]
    schema = kept_schema = _fields(host="text", echo_id="text", echo_seq="text", us="long", seq="long", reply="flag")

    def __init__(self, max_rtt_micros: int):
        self.lag = max_rtt_micros

    def take(self, key, due: pd.DataFrame, watermark: int, more: bool) -> pd.DataFrame | None:
        old = self.before()
        rows = pd.concat([old, due], ignore_index=True)
        if not len(rows):
            return None
        code = rows.groupby(self.KEYS, sort=False).ngroup().to_numpy()
        order = np.lexsort((rows["reply"], rows["seq"], rows["us"], code))
        us, seq = rows["us"].to_numpy()[order], rows["seq"].to_numpy()[order]
        code = code[order]
        # rows that repeat time and number are one event
        one = np.append((code[1:] != code[:-1]) | (us[1:] != us[:-1]) | (seq[1:] != seq[:-1]), True)
        order, us, seq, code = order[one], us[one], seq[one], code[one]
        reply = rows["reply"].to_numpy(bool)[order]
        at = np.arange(len(code))
        # an event without a number is before later ones, but not before others of its own time
        back = np.where((at > 0) & (seq[at - 1] == NULL) & (us[at - 1] == us) & (code[at - 1] == code), at - 2, at - 1)
        found = (back >= 0) & (code[back] == code) & reply & ~reply[back] & (us - us[back] <= self.lag) & (order >= len(old))
        last = np.append(code[1:] != code[:-1], True)
        left = last & (us >= watermark - 2 * self.lag)
        self.keep(rows.iloc[order[left]], 2 * self.lag)
        of = rows.iloc[order[found]]
        return pd.DataFrame({**{k: of[k].to_numpy() for k in self.KEYS}, "request_seq": seq[back[found]], "reply_seq": seq[found],
                             "rtt_us": us[found] - us[back[found]]})


def stream_icmp_rtt(icmp: DataFrame, delay: str = "10 minutes", max_rtt: str = "1 hour") -> DataFrame:
    """``sessions.icmp_rtt`` on a stream, for round trips of at most ``max_rtt``.

    A reply takes the latest request since the reply before it, so it has one if the
    event just before it, of its (host, id, seq), is a request.  Events are taken in
    order, each once, with the last event of a key as its state; a reply appears once
    the watermark is ``max_rtt`` past it.
    """
    use_keyed_state(icmp.sparkSession)
    e = (icmp.filter(F.col("icmp_type").isin(ECHO_REQUEST + ECHO_REPLY))
         .withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
         .withColumn("reply", F.col("icmp_type").isin(ECHO_REPLY))
         .withColumn("host", F.when(F.col("reply"), F.col("dst_ip")).otherwise(F.col("src_ip"))))
    # an event without key or time answers nothing
    e = e.dropna(subset=["ts", *_Echo.KEYS])
    types = e.schema
    e = e.select("ts", _bucket(*_Echo.KEYS).alias("bucket"), *[F.col(k).cast("string").alias(k) for k in _Echo.KEYS],
                 F.unix_micros("ts").alias("us"), _number("seq").alias("seq"), "reply")
    met = e.groupBy("bucket").transformWithStateInPandas(
        _Echo(_micros(max_rtt)), "host string, echo_id string, echo_seq string, request_seq long, reply_seq long, rtt_us long",
        "Append", "EventTime")
    return met.select(*[F.col(k).cast(types[k].dataType).alias(k) for k in _Echo.KEYS],
                      *[F.nullif(c, F.lit(NULL)).alias(c) for c in ("request_seq", "reply_seq")],
                      (F.col("rtt_us") / 1000.0).alias("rtt_ms"))


# ---- alerts -----------------------------------------------------------------

MINUTE = 60_000_000
HOUR = 60 * MINUTE
_COUNTS = ("n", "http", "http_err", "dns", "nx", "lat_sum", "lat_n")
RULE = "id string, name string, metric string, condition string, threshold double, window_minutes int, cooldown_minutes int"
EVENTS = ("rule_id string, rule_name string, metric string, value double, threshold double, fired_at timestamp, "
          "condition string, window_minutes int")


def minute_load(flows: DataFrame, delay: str) -> DataFrame:
    """What alert metrics need of each minute, once it is closed."""
    http, dns, lat = F.col("protocol") == "HTTP", F.col("protocol") == "DNS", D._web_latency()
    f = flows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return f.groupBy(F.window("ts", "1 minute").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(http).alias("http"),
        F.count_if(http & (F.col("http_status") >= 400)).alias("http_err"), F.count_if(dns).alias("dns"),
        F.count_if(dns & (F.col("dns_rcode") == 3)).alias("nx"), F.coalesce(F.sum(lat), F.lit(0)).cast("long").alias("lat_sum"),
        F.count(lat).alias("lat_n")).select(F.window_time("w").alias("ts"), F.unix_micros("w.end").alias("us"), *_COUNTS)


class _Rule(_Ordered):
    """One alert rule over closed minutes: its metric every minute, its cooldown.

    Holds the minutes of its window (five at least), whole hours of the baseline
    range, and when it last fired.  Minutes without flows are evaluated too, up to
    the last one that the watermark has closed.
    """

    schema = _fields(us="long", **dict.fromkeys(_COUNTS, "long"))
    hours_schema = _fields(us="long", n="long", lat_sum="long", lat_n="long")

    def __init__(self, baseline_days: int):
        self.base = 24 * baseline_days * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.rule = handle.getValueState("rule", RULE)
        self.minutes = handle.getValueState("minutes", "rows binary")
        self.hours = handle.getValueState("hours", "rows binary")
        self.at = handle.getValueState("at", "next long, fired long")

    def begin(self, part: pd.DataFrame) -> None:
        if not self.rule.exists():
            r = part.iloc[0]
            self.rule.update((r["id"], r["name"], r["metric"], r["condition"], float(r["threshold"]),
                              int(r["window_minutes"]), int(r["cooldown_minutes"])))

    def take(self, key, due: pd.DataFrame, watermark: int, more: bool) -> pd.DataFrame | None:
        name, metric, condition, threshold, window, cooldown = tuple(self.rule.get())[1:]
        first = int(due["us"].min()) if len(due) else None
        nxt, fired = tuple(self.at.get()) if self.at.exists() else (first, -1)
        if nxt is None:
            return None
        kept = _unpack([self.minutes.get()[0]] if self.minutes.exists() else [], self.schema)
        hours = _unpack([self.hours.get()[0]] if self.hours.exists() else [], self.hours_schema)
        of_due = due[["n", "lat_sum", "lat_n"]].assign(us=(due["us"] - MINUTE) // HOUR * HOUR)
        hours = pd.concat([hours, of_due], ignore_index=True).groupby("us", sort=True, as_index=False).sum()
        until = watermark // MINUTE * MINUTE
        times = np.arange(nxt, until + 1, MINUTE)
        near = pd.concat([kept, due], ignore_index=True).sort_values("us")
        value = self._values(metric, window, near[self.schema.names].to_numpy(np.int64), hours, times)
        over = {"gt": value > threshold, "lt": value < threshold}.get(condition, np.zeros(len(times), bool))
        out = []
        for i in np.nonzero(over)[0].tolist():
            now = int(times[i])
            if fired < 0 or now - fired >= cooldown * MINUTE:
                out.append((key[0], name, metric, float(value[i]), threshold, now, condition, window))
                fired = now
        nxt = max(nxt, until + MINUTE)
        for state, rows, schema in ((self.minutes, near[near["us"] > nxt - max(window, 5) * MINUTE], self.schema),
                                    (self.hours, hours[hours["us"] >= nxt - self.base], self.hours_schema)):
            if len(rows):
                state.update((_pack(rows, schema),))
            else:
                state.clear()
        self.at.update((nxt, fired))
        if not more:
            self.wake_at(nxt)
        if not out:
            return None
        df = pd.DataFrame(out, columns=["rule_id", "rule_name", "metric", "value", "threshold", "fired_at", "condition", "window_minutes"])
        df["fired_at"] = pd.to_datetime(df["fired_at"], unit="us")
        return df

    def _values(self, metric: str, window: int, rows: np.ndarray, hours: pd.DataFrame, times: np.ndarray) -> np.ndarray:
        """The metric at each time; nan where it has no value."""
        if not len(times):
            return np.zeros(0)
        upto = np.concatenate([np.zeros((1, len(_COUNTS)), np.int64), np.cumsum(rows[:, 1:], axis=0)])
        ends = rows[:, 0]

        def total(minutes: int) -> dict[str, np.ndarray]:
            sums = upto[np.searchsorted(ends, times, "right")] - upto[np.searchsorted(ends, times - minutes * MINUTE, "right")]
            return dict(zip(_COUNTS, sums.T, strict=True))

        t = total(window)
        if metric == "flows_per_minute":
            return t["n"] / float(window)
        if metric == "http_error_rate":
            return t["http_err"] * 100.0 / np.maximum(t["http"], 1)
        if metric == "dns_nxdomain_rate":
            return t["nx"] * 100.0 / np.maximum(t["dns"], 1)
        out = np.full(len(times), np.nan)
        now = total(5)
        # the whole hours of the baseline range change with the hour only
        lo, hi = -(-(times - self.base) // HOUR) * HOUR, times // HOUR * HOUR - 2 * HOUR
        edges = np.nonzero(np.diff(lo, prepend=lo[:1] - 1) | np.diff(hi, prepend=hi[:1] - 1))[0]
        whole = hours[["n", "lat_sum", "lat_n"]].to_numpy(np.int64)
        start, stop = np.searchsorted(hours["us"], lo, "left"), np.searchsorted(hours["us"], hi, "right")
        for i, j in zip(edges, [*edges[1:], len(times)], strict=True):
            base = whole[start[i]:max(start[i], stop[i])].tolist()
            if metric == "anomaly_flow_rate":
                counts = [int(v[0]) for v in base if v[0] > 0]
                level = np.array(counts, float)
                # from whole sums, so that a deviation of exactly 1 is 1
                std = math.sqrt(len(counts) * sum(c * c for c in counts) - sum(counts) ** 2) / max(len(counts), 1)
                seen = now["n"][i:j] * 12.0
            elif metric == "anomaly_http_latency":
                level = np.array([v[1] / v[2] for v in base if v[2] > 0])
                std = level.std() if len(level) else 0.0
                n = now["lat_n"][i:j]
                seen = np.where(n > 0, now["lat_sum"][i:j] / np.maximum(n, 1), np.nan)
            else:
                continue
            out[i:j] = 0.0 if std < 1 else (seen - level.mean()) / std
        return out


def stream_alerts(flows: DataFrame, rules: DataFrame, delay: str = "10 minutes", baseline_days: int = 7) -> DataFrame:
    """Alert events of a flow stream: every closed minute, each enabled rule looks at its
    window up to that minute's end and fires if its metric breaches the threshold and its
    cooldown is over.

    Minutes are aggregated first; a rule then is one key with a state of bounded size
    (its window's minutes, the baseline's hours, its last firing), so nothing grows with
    the run.  A rule evaluates from the first minute with flows on, silent minutes
    included, as far as the watermark has closed them.  Baselines are over whole hours.
    """
    use_keyed_state(flows.sparkSession)
    r = rules.filter(F.col("enabled")).select(
        "id", "name", "metric", "condition", F.col("threshold").cast("double").alias("threshold"),
        F.coalesce(F.nullif("window_minutes", F.lit(0)), F.lit(5)).cast("int").alias("window_minutes"),
        F.coalesce(F.nullif("cooldown_minutes", F.lit(0)), F.lit(15)).cast("int").alias("cooldown_minutes"))
    # one row a minute for each of the configured rules, which go to every task: a product of partitions would
    # compute a partition of minutes once for each partition of rules, and so save its state as often
    minutes = minute_load(flows, delay).join(F.broadcast(r))
    fired = minutes.groupBy("id").transformWithStateInPandas(
        _Rule(baseline_days), EVENTS, "Append", "EventTime", eventTimeColumnName="fired_at")
    return fired.select("rule_id", "rule_name", "metric", "value", "threshold", "fired_at", D.alert_message(
        F.col("rule_name"), F.col("metric"), F.col("condition"), F.col("value"), F.col("threshold"), F.col("window_minutes")).alias("message"))
