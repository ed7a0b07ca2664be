"""Event streams of model answers: line parsing, stateful reassembly over a stream, and its batch twin."""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

END = "[DONE]"
# Seconds of quiet before a refresh, milliseconds before a selection is acted on.
QUIET, DEFER_MS = 0.12, 50
#: Milliseconds without a chunk after which a request is given up.
EXPIRY_MS = 120_000
PATH = "$.choices[0].delta.content"


def parse_line(line: Column) -> Column:
    """struct(text, done) of one line; anything but a data line, and broken JSON, is empty text."""
    data = F.when(F.startswith(line, F.lit("data: ")), F.substring(line, 7, 1 << 30))
    done = F.coalesce(F.trim(data) == END, F.lit(False))
    return F.struct(F.when(done, "").otherwise(F.coalesce(F.get_json_object(data, PATH), F.lit(""))).alias("text"), done.alias("done"))


def parse_event(line: str) -> tuple[str, bool]:
    if not line.startswith("data: "):
        return "", False
    data = line[6:]
    if data.strip() == END:
        return "", True
    try:
        text = json.loads(data)["choices"][0]["delta"]["content"]
    except (ValueError, KeyError, IndexError, TypeError):
        return "", False
    return (text, False) if isinstance(text, str) else ("", False)


def reassemble(chunks: DataFrame) -> DataFrame:
    """request_id, text, done of (request_id, seq, chunk): chunks in order, cut into lines, text up to the end mark.

    A request's chunks are one string only inside its own group; lines after the end mark are ignored, and a last line
    without a break counts.
    """
    whole = chunks.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "").alias("all"))
    lines = whole.select("request_id", F.posexplode(F.split("all", "\n")).alias("pos", "line")).withColumn("e", parse_line(F.trim(F.regexp_replace("line", r"\r\z", ""))))
    before = Window.partitionBy("request_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    live = lines.withColumn("over", F.coalesce(F.max(F.col("e.done")).over(before), F.lit(False))).where("not over")
    return live.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("e.text").alias("t")))), lambda x: x["t"]), "").alias("text"), F.max("e.done").alias("done"))


class Reassembler(StatefulProcessor):
    """Per request: the unfinished line, chunks that came early (by seq), the text so far. Emits each increment and whether it is the last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sse", "held string, next bigint, early string, text string, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, nxt, early, text, done = self.state.get() if self.state.exists() else ("", 0, "{}", "", False)
        waiting = {int(k): v for k, v in json.loads(early).items()}
        for batch in rows:
            waiting.update({int(s): c for s, c in zip(batch["seq"], batch["chunk"]) if int(s) >= nxt})
        more = ""
        while nxt in waiting:
            held += waiting.pop(nxt)
            nxt += 1
            *lines, held = held.split("\n")
            for line in lines:
                if not done:
                    part, done = parse_event(line.strip())
                    more += part
        text += more
        self.state.update((held, nxt, json.dumps(waiting), text, done))
        if more or done:
            yield pd.DataFrame({"request_id": [key[0]], "increment": [more], "text": [text], "done": [done]})

    def close(self) -> None:
        pass


def reassemble_stream(chunks: DataFrame) -> DataFrame:
    """Streaming form over (request_id, seq, chunk); the state store must be RocksDB."""
    return chunks.groupBy("request_id").transformWithStateInPandas(Reassembler(), "request_id string, increment string, text string, done boolean", "Append", "None")


class Increments(StatefulProcessor):
    """Per request: the unfinished line and the number of the next chunk as a value, chunks that came early as a map. Text that went
    out is no state, only its length is; a request that has been quiet for ``expiry_ms`` is closed and forgotten."""

    def __init__(self, expiry_ms: int):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.line = handle.getValueState("line", "held string, next bigint, sent bigint, done boolean, timer bigint")
        self.early = handle.getMapState("early", "seq bigint", "chunk string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, nxt, sent, done, timer = self.line.get() if self.line.exists() else ("", 0, 0, False, None)
        for batch in rows:
            for seq, chunk in zip(batch["seq"], batch["chunk"]):
                if not done and int(seq) >= nxt:
                    self.early.updateValue((int(seq),), (chunk or "",))
        more = ""
        while not done and self.early.containsKey((nxt,)):
            held += self.early.getValue((nxt,))[0]
            self.early.removeKey((nxt,))
            nxt += 1
            *lines, held = held.split("\n")
            for line in lines:
                if not done:
                    part, done = parse_event(line.strip())
                    more += part
        if done:
            held = ""
            self.early.clear()
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.expiry_ms
        self.handle.registerTimer(timer)
        self.line.update((held, nxt, sent + len(more), done, timer))
        if more or done:
            yield pd.DataFrame({"request_id": [key[0]], "at": [sent], "increment": [more], "done": [done], "expired": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, _, sent, done, _ = self.line.get()
        part, last = ("", True) if done else parse_event(held.strip())
        self.line.clear()
        self.early.clear()
        yield pd.DataFrame({"request_id": [key[0]], "at": [sent], "increment": [part], "done": [last], "expired": [True]})

    def close(self) -> None:
        pass


def increments_stream(chunks: DataFrame, expiry_ms: int = EXPIRY_MS) -> DataFrame:
    """request_id, at (characters before), increment, done, expired over (request_id, seq, chunk): what each micro-batch adds to an answer.

    Increments in order of ``at`` are the text of :func:`reassemble`. Chunks after the end mark or of a number already read are ignored;
    a request without new chunks for ``expiry_ms`` of processing time gives its unfinished line as a last increment, marked
    expired, and its state goes. Not done and expired says that the answer broke off. Timers of processing time keep a
    query going until it is stopped. The state store must be RocksDB.
    """
    return chunks.groupBy("request_id").transformWithStateInPandas(Increments(expiry_ms), "request_id string, at bigint, increment string, done boolean, expired boolean", "Append", "ProcessingTime")


class Settle(StatefulProcessor):
    """Per key: rows that a later one may still replace, by time, and one timer for the oldest of them."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at_ms bigint", "payload string")
        self.timer = handle.getValueState("timer", "at_ms bigint")

    def _arm(self, oldest: int | None) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if oldest is not None:
            self.handle.registerTimer(oldest + self.quiet_ms + 1)
            self.timer.update((oldest + self.quiet_ms + 1,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for at, payload in zip(batch["at_ms"], batch["payload"]):
                held = self.waiting.getValue((int(at),)) if self.waiting.containsKey((int(at),)) else None
                self.waiting.updateValue((int(at),), (payload if held is None else max(held[0], payload),))
        self._arm(min((k[0] for k in self.waiting.keys()), default=None))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        times = sorted(k[0] for k in self.waiting.keys())
        settled = [t for t in times if t + self.quiet_ms < passed]
        kept = [(t, self.waiting.getValue((t,))[0]) for t, n in zip(times, [*times[1:], None]) if t + self.quiet_ms < passed and (n is None or n - t > self.quiet_ms)]
        for t in settled:
            self.waiting.removeKey((t,))
        self.timer.clear()
        self._arm(min((t for t in times if t + self.quiet_ms >= passed), default=None))
        if kept:
            yield pd.DataFrame({"key": [key[0]] * len(kept), "at_ms": [t for t, _ in kept], "payload": [p for _, p in kept]})

    def close(self) -> None:
        pass


def settled_stream(rows: DataFrame, key: str, at: str, quiet_ms: int = DEFER_MS, late_ms: int = 0) -> DataFrame:
    """The rows of a stream that no row of the same key follows within ``quiet_ms``: the last of each burst.

    ``at`` is a timestamp. A row goes out once the watermark has passed its quiet time, so rows up to ``late_ms`` late count as if
    they had come in order; later ones are dropped. Of rows of one key and millisecond one stays (that of the largest JSON).
    With :data:`DEFER_MS` it is the streaming form of :func:`last_selection`; with ``QUIET`` seconds a burst of progress
    events refreshes once. The state store must be RocksDB.
    """
    marked = rows.withWatermark(at, f"{late_ms} milliseconds")
    given = marked.select(F.col(key).cast("string").alias("key"), F.unix_millis(F.col(at)).alias("at_ms"), F.to_json(F.struct(*rows.columns)).alias("payload"), F.col(at).alias("_at"))
    kept = given.groupBy("key").transformWithStateInPandas(Settle(quiet_ms), "key string, at_ms bigint, payload string", "Append", "EventTime")
    return kept.select(F.from_json("payload", rows.schema).alias("r")).select("r.*")


def latest_progress(events: DataFrame) -> DataFrame:
    """The last event of each job so far (for update-mode sinks)."""
    return events.groupBy("job_id").agg(F.max_by(F.struct("stage", "message", "at_ms"), F.struct("at_ms", "ord")).alias("e")).select("job_id", "e.*")


class Debouncer:
    """Calls ``refresh`` once a burst of events has been quiet for a while (the last event's arguments count)."""

    def __init__(self, refresh, quiet: float = QUIET):
        self.refresh, self.quiet, self.timer, self.lock = refresh, quiet, None, threading.Lock()

    def __call__(self, *args) -> None:
        with self.lock:
            if self.timer:
                self.timer.cancel()
            self.timer = threading.Timer(self.quiet, self.refresh, args)
            self.timer.daemon = True
            self.timer.start()


class Throttle(StatefulProcessor):
    """Per job: a progress row passes if the last one that passed is at least ``gap`` milliseconds older."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("throttle", "last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get()[0] if self.state.exists() else None
        kept = []
        for at, ord_ in sorted((int(a), int(o)) for batch in rows for a, o in zip(batch["at_ms"], batch["ord"])):
            if last is None or at - last >= self.gap:
                last = at
                kept.append((key[0], ord_, at))
        if kept:
            self.state.update((last,))
            yield pd.DataFrame(kept, columns=["job_id", "ord", "at_ms"])

    def close(self) -> None:
        pass


def throttle_stream(events: DataFrame, gap: int = 1000) -> DataFrame:
    """Streaming form of :func:`quire.operators.jobs.throttled` over (job_id bigint, ord, at_ms); the state store must be RocksDB.

    Rows are put in order inside a micro-batch; one that comes in a later batch than a newer row that passed doesn't pass.
    """
    return events.groupBy("job_id").transformWithStateInPandas(Throttle(gap), "job_id bigint, ord bigint, at_ms bigint", "Append", "None")


def last_selection(selections: DataFrame, quiet_ms: int = DEFER_MS) -> DataFrame:
    """Of the selections (reader, at_ms, ...) of a reader that follow each other within ``quiet_ms`` only the last is acted on."""
    w = Window.partitionBy("reader").orderBy("at_ms")
    return selections.withColumn("_n", F.lead("at_ms").over(w)).where(F.col("_n").isNull() | (F.col("_n") - F.col("at_ms") > quiet_ms)).drop("_n")


def fan_out(*sinks):
    """A foreachBatch function that hands each micro-batch to every sink; one sink's error doesn't keep the others from theirs."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        errors = []
        try:
            for sink in sinks:
                try:
                    sink(batch, number)
                except Exception as e:  # noqa: BLE001
                    errors.append(e)
        finally:
            batch.unpersist()
        if len(errors) == len(sinks) and errors:
            raise errors[0]

    return each


def route_selections(selections: DataFrame, pages: DataFrame) -> DataFrame:
    """Stream-static join of selections (doc_id, page, selected, action) with their page's paragraphs, and the level the action asks for."""
    from quire.functions.text import context_level

    level = context_level(F.col("selected"))
    asked = F.when(F.col("action") == "lookup", 1).when((F.col("action") == "translate") & (level == 1), 2).otherwise(level)
    return selections.join(pages.select("doc_id", "page", "paragraphs"), ["doc_id", "page"], "left").withColumn("level", level).withColumn("asked_level", asked)
