"""Batches of requests handed to a reviewer, and what becomes of them.

The state is four tables below a folder, all only ever appended to: ``manifest`` (cid, book, items), ``batches`` (id, n,
model, created), ``results`` (cid, text, in, out, error, file, line) and ``collected`` (id). A request's number goes on
from the manifest's length, so no run reuses one; issues are always derived anew from all that was sent and answered, so
a later run keeps what earlier ones found.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from . import review

MANIFEST = "cid string, book string, items array<struct<f:string,i:int>>"
BATCHES = "id string, n bigint, model string, created string"
RESULTS = "cid string, text string, `in` bigint, `out` bigint, error string, file string, line bigint"
COLLECTED = "id string"
PILOT_BOOKS = 3
# Fixed value: what the issues' column ``model`` says.
MODEL_NAME = "claude"


class Client(Protocol):
    """What stands between the engine and a reviewer's service. It is sent to the executors, so it has to be picklable."""

    def create(self, name: str, requests: list[tuple[str, str]]) -> str:
        """Hands over requests (cid, params); returns the batch's id. A name that was handed over before is the same batch."""

    def status(self, batch: str) -> dict:
        """state (``ended`` when all is done) and the counts ok, failed, open and expired."""

    def results(self, batch: str) -> list[dict]:
        """cid with text, in and out, or with error, of each request."""

    def complete(self, params: str) -> str:
        """The answer to one request, at once."""

    def count_tokens(self, params: str) -> int:
        """How many tokens a request has."""


class OfflineClient:
    """A client without a network: batches are files in a folder that all executors reach, answered when asked for."""

    def __init__(self, folder: str, reviewer: Callable[[str], str] = review.offline_reviewer) -> None:
        self.folder, self.reviewer = folder.rstrip("/"), reviewer

    def _read(self, batch: str) -> list:
        files, place = store._files(f"{self.folder}/{batch}.json")
        with files.open_input_stream(place) as f:
            return json.loads(f.read())

    def create(self, name: str, requests: list[tuple[str, str]]) -> str:
        store.write_text(json.dumps(requests), f"{self.folder}/{name}.json")
        return name

    def status(self, batch: str) -> dict:
        return {"state": "ended", "ok": len(self._read(batch)), "failed": 0, "open": 0, "expired": 0}

    def results(self, batch: str) -> list[dict]:
        return review.answered(self._read(batch), self.reviewer).to_pylist()

    def complete(self, params: str) -> str:
        return self.reviewer(params)

    def count_tokens(self, params: str) -> int:
        return len(params) // 4


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return store.read(spark, f"{folder}/{name}", {"manifest": MANIFEST, "batches": BATCHES, "results": RESULTS, "collected": COLLECTED}[name])


def next_number(spark: SparkSession, folder: str) -> int:
    return table(spark, folder, "manifest").count()


def _noted(rows: DataFrame, folder: str, first: int) -> DataFrame:
    """``rows`` as written to a table of their own, and added to the manifest: before anything is sent."""
    place = f"{folder}/requests/first={first}"
    rows.write.mode("overwrite").parquet(place)
    told = rows.sparkSession.read.parquet(place)
    told.select("cid", "book", "items").write.mode("append").parquet(f"{folder}/manifest")
    return told


def submit(rows: DataFrame, folder: str, client: Client, model: str, first: int) -> DataFrame:
    """Hands over requests (from ``review.requests``, numbered from ``first`` on) batch by batch; returns the batches' rows.

    A batch is sent by one task. Its name follows from its first request, so a task that is run again after a lost
    executor hands over nothing twice.
    """
    noted = _noted(rows, folder, first)

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def sent() -> pa.RecordBatch:
            got = client.create(f"batch-{held[0][0]}", held)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((got, pa.string()), (len(held), pa.int64()), (model, pa.string()), (time.strftime("%Y-%m-%d %H:%M:%S"), pa.string()))], names=["id", "n", "model", "created"])

        for part in parts:
            for batch, cid, params in zip(*(c.to_pylist() for c in part.columns)):
                if batch != key:
                    if held:
                        yield sent()
                    key, held = batch, []
                held.append((cid, params))
        if held:
            yield sent()

    tasks = int(noted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    handed = noted.select("batch", "cid", "params").repartition(tasks, "batch").sortWithinPartitions("batch", "cid").mapInArrow(send, BATCHES)
    handed.write.mode("append").parquet(f"{folder}/batches")
    return table(noted.sparkSession, folder, "batches")


def status(spark: SparkSession, folder: str, client: Client) -> DataFrame:
    """id, n, model, created, collected, and what the client says of each batch: state, ok, failed, open, expired."""
    known = table(spark, folder, "batches").join(table(spark, folder, "collected").distinct().withColumn("collected", F.lit(True)), "id", "left").withColumn("collected", F.coalesce("collected", F.lit(False)))

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            told = [client.status(i) for i in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([t["state"] for t in told], pa.string()), *(pa.array([t[k] for t in told], pa.int64()) for k in ("ok", "failed", "open", "expired"))],
                                             names=[*part.schema.names, "state", "ok", "failed", "open", "expired"])

    return known.mapInArrow(ask, f"{BATCHES}, collected boolean, state string, ok bigint, failed bigint, open bigint, expired bigint")


def collect(spark: SparkSession, folder: str, client: Client) -> DataFrame:
    """Fetches what has ended and isn't collected yet; returns the ids of the batches that still aren't.

    Results are written before a batch counts as collected. If that is cut short, the next call writes them again, with
    the same file and line, and they count once.
    """
    ended = status(spark, folder, client).where("NOT collected AND state = 'ended'").select("id")

    def fetch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch in part.column(0).to_pylist():
                rows = client.results(batch)
                kinds = (("cid", pa.string()), ("text", pa.string()), ("in", pa.int64()), ("out", pa.int64()), ("error", pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([r.get(k) for r in rows], t) for k, t in kinds), pa.array([batch] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64())], names=["cid", "text", "in", "out", "error", "file", "line"])

    place = store.scratch(spark, "ended")
    ended.write.parquet(place)
    now = store.read(spark, place, COLLECTED)
    now.repartition(max(1, min(now.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))).mapInArrow(fetch, RESULTS).write.mode("append").parquet(f"{folder}/results")
    now.write.mode("append").parquet(f"{folder}/collected")
    return table(spark, folder, "batches").select("id").join(table(spark, folder, "collected"), "id", "left_anti")


def pilot(rows: DataFrame, folder: str, client: Client, first: int, parallel: int = 4) -> DataFrame:
    """Puts requests to the client at once; returns all results so far."""
    noted = _noted(rows, folder, first)
    got = review.run_reviewer(noted, client.complete, parallel).withColumn("file", F.lit(f"pilot-{first:07d}")).withColumn("line", F.substr("cid", F.lit(2)).cast("bigint"))
    got.write.mode("append").parquet(f"{folder}/results")
    return results(noted.sparkSession, folder)


def results(spark: SparkSession, folder: str) -> DataFrame:
    """All results; one that was written twice counts once."""
    return table(spark, folder, "results").dropDuplicates(["file", "line", "cid"])


def issues(spark: SparkSession, folder: str, blocks: DataFrame, min_conf: float = review.MIN_CONF) -> DataFrame:
    """The claims of all answers of all runs, verified or not (``ok``), as issues of source ``grammar`` in order of request."""
    told = review.rebuild_issues(table(spark, folder, "manifest"), results(spark, folder), blocks, min_conf)
    order = F.substr("cid", F.lit(2)).cast("bigint") * 100_000 + F.col("k")
    return told.withColumn("source", F.lit("grammar")).withColumn("model", F.lit(MODEL_NAME)).withColumn("seq", order)
