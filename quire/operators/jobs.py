"""Translation jobs: progress, filters, usage, event rings, throttled persistence, reuse and recovery, and a driver that runs them."""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import KEY_MASK, TOKEN_MASK, redact

# Stages in order, and the classes jobs are filtered by.
STAGES = ("extracting", "structuring", "terminology", "translating", "validating", "rendering", "attaching", "completed")
ACTIVE = ("queued", *STAGES[:-1], "paused")
FAILED = ("failed", "cancelled")
HALTED = ("paused", "failed", "cancelled", "queued")
# Events kept and shown, milliseconds between persisted progress rows, attempts of a request, first backoff and longest wait for a halt in seconds.
EVENTS, EVENTS_SHOWN, THROTTLE_MS, ATTEMPTS, BACKOFF, HALT_WAIT = 80, 20, 1000, 3, 1.0, 3.0


def effective_stage(stage: Column, last: Column) -> Column:
    return F.when(stage.isin(*HALTED) & (F.coalesce(last, F.lit("")) != ""), last).otherwise(stage)


def progress_percent(stage: Column, last: Column, completed: Column, total: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, STAGES)), effective_stage(stage, last)) - 1
    part = F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), completed / total))).otherwise(0.0)
    return F.when(stage == "completed", 100.0).when(at < 0, 0.0).otherwise(F.least(F.lit(99.0), (at + part) / len(STAGES) * 100))


def in_class(stage: Column, wanted: str) -> Column:
    return {"all": F.lit(True), "active": stage.isin(*ACTIVE), "completed": stage == "completed", "failed": stage.isin(*FAILED)}[wanted]


def summary(jobs: DataFrame, history: DataFrame) -> DataFrame:
    """One row: history, active and completed counts."""
    counts = jobs.agg(F.count_if(in_class(F.col("stage"), "active")).alias("active_jobs"), F.count_if(F.col("stage") == "completed").alias("completed_jobs"))
    total = history.agg(F.count(F.lit(1)).alias("history"))
    return counts.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k").drop("_k")


def usage(requests: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """job_id with prompt, completion, total and requests summed; missing parts count 0; ``before`` is added."""
    parts = ("prompt", "completion", "total")
    rows = requests.select("job_id", *parts, F.lit(1).cast("bigint").alias("requests"))
    if before is not None:
        rows = rows.unionByName(before.select("job_id", *parts, "requests"))
    return rows.groupBy("job_id").agg(*[F.coalesce(F.sum(p), F.lit(0)).cast("bigint").alias(p) for p in (*parts, "requests")])


def event_ring(events: DataFrame, most: int = EVENTS) -> DataFrame:
    """The last events of each job (by ord), messages redacted."""
    r = F.row_number().over(Window.partitionBy("job_id").orderBy(F.col("ord").desc()))
    return events.withColumn("_r", r).where(F.col("_r") <= most).drop("_r").withColumn("message", redact(F.col("message")))


def throttled(rows: DataFrame, gap: int = THROTTLE_MS) -> DataFrame:
    """Rows (job_id, ord, at_ms) at least ``gap`` after the last one kept, which a lag can't tell.

    A job's rows pass in order through one iterator that holds the last time kept: no list of them is ever made.
    """
    names = rows.columns
    inner = rows.toDF(*[f"c{i}" for i in range(len(names))])
    job, ord_, at = (f"c{names.index(c)}" for c in ("job_id", "ord", "at_ms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = None, None
        for batch in batches:
            keep = []
            for j, ms in zip(batch.column(job).to_pylist(), batch.column(at).to_pylist()):
                if j != own or last is None:
                    own, last, take = j, ms, True
                else:
                    take = ms is not None and ms - last >= gap
                    last = ms if take else last
                keep.append(take)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return inner.repartition(job).sortWithinPartitions(job, ord_).mapInArrow(run, inner.schema).toDF(*names)


def latest(rows: DataFrame, key: str = "id", by: str = "updated_ms") -> DataFrame:
    """Live over stored: the row of a job updated last (of several at one time the one that is largest as JSON)."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.col(by).desc(), F.to_json(F.struct(*rows.columns)).desc()))
    return rows.withColumn("_r", r).where("_r = 1").drop("_r")


def reusable(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """requests (attachment_id, fingerprint) with job_id and action: resume an unfinished match, return one whose output exists, requeue it
    otherwise, create if there is none. Of several matches that aren't cancelled the one updated last counts."""
    alive = jobs.where("stage <> 'cancelled'")
    r = F.row_number().over(Window.partitionBy("attachment_id", "fingerprint").orderBy(F.col("updated_ms").desc(), "id"))
    best = alive.withColumn("_r", r).where("_r = 1").select("attachment_id", "fingerprint", F.col("id").alias("job_id"), "stage", "output_exists")
    joined = requests.join(best, ["attachment_id", "fingerprint"], "left")
    action = F.when(F.col("job_id").isNull(), "create").when(F.col("stage") != "completed", "resume").when(F.coalesce("output_exists", F.lit(False)), "return").otherwise("requeue")
    return joined.withColumn("action", action).drop("stage", "output_exists")


def recover(jobs: DataFrame, live: DataFrame, documents: DataFrame) -> DataFrame:
    """Active jobs that nothing runs become paused; a missing last stage follows from the saved document (blocks, translated)."""
    running = live.select("id", F.lit(True).alias("_live"))
    joined = jobs.join(running, "id", "left").join(documents, "id", "left")
    stopped = in_class(F.col("stage"), "active") & (F.col("stage") != "paused") & F.col("_live").isNull()
    guess = F.when(F.coalesce("blocks", F.lit(0)) == 0, "extracting").when(F.coalesce("translated", F.lit(0)) < F.col("blocks"), "translating").otherwise("validating")
    last = F.coalesce("last_active_stage", F.when(F.col("stage").isin(*STAGES[:-1]), F.col("stage")), guess)
    return joined.withColumn("last_active_stage", F.when(stopped, last).otherwise(F.col("last_active_stage"))).withColumn("stage", F.when(stopped, "paused").otherwise(F.col("stage"))).select(*jobs.columns)


class Aborted(Exception):
    """A wait or a request that was called off."""


class Truncated(Exception):
    """An answer that was cut off; asked for again like an error without a status."""


def backoff(attempt: int) -> float:
    return BACKOFF * 2**attempt


def abortable_sleep(stop: threading.Event) -> Callable[[float], None]:
    """A sleep that ends in Aborted as soon as ``stop`` is set."""

    def sleep(seconds: float) -> None:
        if stop.wait(seconds):
            raise Aborted

    return sleep


def with_retry(call: Callable, sleep: Callable[[float], None] = time.sleep, attempts: int = ATTEMPTS):
    """Calls until it succeeds; errors with a status that isn't retryable, and aborts, end it at once."""
    for attempt in range(attempts):
        try:
            return call()
        except Aborted:
            raise
        except Exception as e:
            status = getattr(e, "status", None)
            if attempt + 1 == attempts or status is not None and status not in (408, 409, 429) and status < 500:
                raise
            sleep(backoff(attempt))


# The shapes of keys and tokens in messages.
_SECRETS = ((re.compile(r"\bsk-[A-Za-z0-9_-]{8,}\b", re.A), KEY_MASK), (re.compile(r"\beyJ[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\b", re.A), TOKEN_MASK))


def masked(message: str) -> str:
    """The redaction of a single message on the driver."""
    for pattern, mask in _SECRETS:
        message = pattern.sub(mask, message)
    return message


class JobStore:
    """One JSON file a job under a folder (any pyarrow file system), replaced by a rename."""

    def __init__(self, root: str):
        self.files, self.at = fs.FileSystem.from_uri(root)

    def _path(self, job_id: str) -> str:
        return f"{self.at}/{re.sub('[^A-Za-z0-9_-]', '_', job_id)}/job.json"

    def save(self, job: dict) -> None:
        path = self._path(job["id"])
        self.files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with self.files.open_output_stream(f"{path}.new") as f:
            f.write(json.dumps(job, ensure_ascii=False, default=str).encode())
        self.files.move(f"{path}.new", path)

    def load_all(self) -> list[dict]:
        """All jobs that can be read, the latest first."""
        out = []
        for info in self.files.get_file_info(fs.FileSelector(self.at, allow_not_found=True, recursive=True)):
            if info.path.endswith("/job.json"):
                try:
                    with self.files.open_input_stream(info.path) as f:
                        out.append(json.loads(f.read()))
                except ValueError:
                    continue
        return sorted(out, key=lambda j: -j.get("updated_ms", 0))


@dataclass
class JobManager:
    """Runs the stages of a job over checkpoint tables, with reuse, pause, cancel, resume, repair and an event list.

    With a ``store`` every change of a job is saved, and a new manager finds the jobs again: those that were active are
    paused. With a ``spark`` session a stage's jobs carry the job's tag, and pause and cancel end them at once.
    """

    stages: dict[str, Callable[[dict], dict]]
    consented: bool = False
    jobs: dict[str, dict] = field(default_factory=dict)
    listeners: list[Callable[[dict], None]] = field(default_factory=list)
    store: JobStore | None = None
    spark: SparkSession | None = None
    output_exists: Callable[[dict], bool] = lambda job: True
    refusal: Callable[[dict], str | None] = lambda job: None
    running: dict[str, threading.Event] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for job in self.store.load_all() if self.store else []:
            if job["stage"] in ACTIVE and job["stage"] != "paused":
                last = job["last_active_stage"] or (job["stage"] if job["stage"] in STAGES else STAGES[0])
                job |= {"stage": "paused", "last_active_stage": last}
            self.jobs.setdefault(job["id"], job)

    def subscribe(self, listener: Callable[[dict], None]) -> Callable[[], None]:
        self.listeners.append(listener)
        return lambda: self.listeners.remove(listener)

    def _emit(self, job: dict) -> None:
        for listener in list(self.listeners):
            try:
                listener(dict(job))
            except Exception:  # noqa: BLE001, S112  a listener's error is its own
                continue

    def _save(self, job: dict) -> None:
        job["updated_ms"] = max(int(time.time() * 1000), job.get("updated_ms", 0) + 1)
        if self.store:
            try:
                self.store.save(job)
            except OSError as e:  # the run goes on, the event tells
                job["events"] = [*job["events"], ("save", masked(str(e)))][-EVENTS:]
        self._emit(job)

    def _move(self, job: dict, stage: str, message: str = "") -> None:
        job["stage"] = stage
        if stage in STAGES[:-1]:
            job["last_active_stage"], job["error"] = stage, None
        job["events"] = [*job["events"], (stage, masked(message))][-EVENTS:]
        self._save(job)

    def start(self, job_id: str, fingerprint: str, attachment: str | None = None) -> dict:
        """The latest job of the same attachment (by default its own id) and fingerprint that isn't cancelled: returned if its
        output exists, run on or again otherwise; a new job if there is none."""
        if not self.consented:
            raise PermissionError("the privacy notice isn't accepted")
        attachment = attachment or job_id
        alike = [j for j in self.jobs.values() if j["attachment"] == attachment and j["fingerprint"] == fingerprint and j["stage"] != "cancelled"]
        if alike:
            job = max(alike, key=lambda j: j["updated_ms"])
            if job["stage"] != "completed":
                return self.resume(job["id"])
            return job if self.output_exists(job) else self.rerender(job["id"])
        job = {"id": job_id, "attachment": attachment, "fingerprint": fingerprint, "stage": "queued", "last_active_stage": None, "attempt": 0, "events": [], "error": None, "state": {}, "done": [], "updated_ms": 0}
        self.jobs[job_id] = job
        self._save(job)
        return self.resume(job_id)

    def resume(self, job_id: str) -> dict:
        """Runs what is left of a job; a job that runs already is left to itself, one that may not run is refused."""
        job = self.jobs[job_id]
        if job_id in self.running:
            return job
        if why := self.refusal(job):
            raise PermissionError(why)
        job["attempt"] += 1
        job["run"] = uuid.uuid4().hex
        over = self.running[job_id] = threading.Event()
        try:
            return self._run(job)
        finally:
            self.running.pop(job_id, None)
            over.set()

    def _run(self, job: dict) -> dict:
        for name in STAGES[:-1]:
            if name in job["done"] or name not in self.stages:
                continue
            self._move(job, name)
            if self.spark:
                self.spark.sparkContext.addJobTag(f"job-{job['id']}")
            try:
                job["state"] = self.stages[name](job["state"])
            except Exception as e:  # noqa: BLE001
                if ended := job.pop("stop", None):  # called off, not failed
                    self._move(job, ended)
                else:
                    job["error"] = masked(str(e))
                    self._move(job, "failed", job["error"])
                return job
            finally:
                if self.spark:
                    self.spark.sparkContext.removeJobTag(f"job-{job['id']}")
            job["done"].append(name)
            if ended := job.pop("stop", None):
                self._move(job, ended)
                return job
        self._move(job, "completed")
        return job

    def _halt(self, job_id: str, stage: str, wait: float) -> None:
        job = self.jobs[job_id]
        job["stop"] = stage
        over = self.running.get(job_id)
        if over:
            if self.spark:
                self.spark.sparkContext.cancelJobsWithTag(f"job-{job_id}")
            over.wait(wait)

    def pause(self, job_id: str, wait: float = HALT_WAIT) -> None:
        """Ends the running stage (an idle job stops after its next one) and waits a little for it."""
        self._halt(job_id, "paused", wait)

    def cancel(self, job_id: str, wait: float = HALT_WAIT) -> None:
        if job_id in self.running:
            self._halt(job_id, "cancelled", wait)
        else:
            self._move(self.jobs[job_id], "cancelled")

    def rerender(self, job_id: str) -> dict:
        return self._again(job_id, ("validating", "rendering", "attaching"))

    def repair(self, job_id: str) -> dict:
        return self._again(job_id, ("translating", "validating", "rendering", "attaching"))

    def _again(self, job_id: str, stages: tuple[str, ...]) -> dict:
        job = self.jobs[job_id]
        job["done"] = [s for s in job["done"] if s not in stages]
        job["stage"] = "queued"
        return self.resume(job_id)
