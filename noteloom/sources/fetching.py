"""Fetching many links: each once, with a rate for each host, a time limit and further tries."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import SLICE_BYTES, SLICE_ROWS
from ..operators.staging import stored

Get = Callable[[str], tuple[int, bytes]]


@dataclass(frozen=True)
class Manners:
    """How hosts are asked: requests a second for each host (None: no limit), shared by so many lanes; seconds until an answer (None: no limit);
    how often a link is tried in all if there is no answer, or one of status 429 or 500 and more; seconds before the second try, doubled for each further one."""

    per_second: float | None = None
    lanes: int = 4
    timeout: float | None = None
    tries: int = 1
    pause: float = 0.5


def within(seconds: float | None, call: Callable, *arguments):
    """call's result, or TimeoutError. A call that is given up goes on in its thread until it ends by itself."""
    if seconds is None:
        return call(*arguments)
    answers: queue.SimpleQueue = queue.SimpleQueue()

    def run() -> None:
        try:
            answers.put((call(*arguments), None))
        except Exception as e:
            answers.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        result, error = answers.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer in {seconds:g} s") from None
    if error is not None:
        raise error
    return result


class Asker:
    """Asks links in a task, each lane of a host in its time."""

    def __init__(self, get: Get, manners: Manners):
        self.get, self.manners, self.next = get, manners, {}

    def wait(self, lane: tuple) -> None:
        if self.manners.per_second is None:
            return
        now = time.monotonic()
        at = max(now, self.next.get(lane, now))
        self.next[lane] = at + self.manners.lanes / self.manners.per_second
        if at > now:
            time.sleep(at - now)

    def ask(self, link: str, lane: tuple) -> tuple[int | None, bytes | None, str | None, int]:
        """status, body, error and the number of tries."""
        tried = 0
        while True:
            tried += 1
            self.wait(lane)
            try:
                status, body = within(self.manners.timeout, self.get, link)
                answer = (status, body, None, tried)
                final = status != 429 and status < 500
            except Exception as e:  # any failure is the row's, not the batch's
                answer, final = (None, None, f"{type(e).__name__}: {e}", tried), False
            if final or tried >= self.manners.tries:
                return answer
            time.sleep(self.manners.pause * 2 ** (tried - 1))


def fetch_by_host(links: DataFrame, client: Callable[[], Get], manners: Manners = Manners()) -> DataFrame:
    """links (link, ...) with status, body, error, tries. client() is called once a task.

    Each link of the batch is fetched once, however many rows have it, and what came is written before it is used. A host's links are dealt to lanes by the link's hash; a lane
    lies in one task and keeps to its share of the host's rate, so that a host with a third of all links has as many tasks as lanes and is still asked no faster than it may be.
    Within a task hosts take turns. Null links have the error 'no link'.
    """
    host = F.lower(F.regexp_extract("link", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    lane = F.pmod(F.xxhash64("link"), F.lit(manners.lanes)).cast("int")
    once = links.where("link is not null").select("link").distinct().select("link", host.alias("host"), lane.alias("lane"))

    out = pa.schema([("link", pa.string()), ("status", pa.int32()), ("body", pa.binary()), ("error", pa.string()), ("tries", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answers are given as soon as there are SLICE_ROWS of them or their bodies have SLICE_BYTES."""
        asker, rows, size = Asker(client(), manners), [], 0

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)

        for batch in batches:
            for link, host, lane in zip(*(batch.column(c).to_pylist() for c in ("link", "host", "lane")), strict=True):
                rows.append((link, *asker.ask(link, (host, lane))))
                size += len(rows[-1][2] or b"")
                if len(rows) >= SLICE_ROWS or size >= SLICE_BYTES:
                    yield given()
                    rows, size = [], 0
        if rows:
            yield given()

    turns = once.repartition("host", "lane").sortWithinPartitions(F.xxhash64(F.lit("turn"), "link"))
    came = stored(turns.mapInArrow(run, "link string, status int, body binary, error string, tries int"), "fetched")
    return links.join(came, "link", "left").withColumn("error", F.when(F.col("link").isNull(), "no link").otherwise(F.col("error"))).select(*links.columns, "status", "body", "error", "tries")
