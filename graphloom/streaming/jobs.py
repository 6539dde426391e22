"""Batch jobs of a model service as a stateful stream: submitted, looked after by timers, collected or cancelled, over restarts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.operators.extraction import TRIES, pause_after

OUT = "job string, chunk_id string, result string, error string, status string"
STATE = "phase string, service_id string, attempt int, chunks array<string>, prompts array<string>, later array<string>, later_prompts array<string>"
# Fixed value: seconds between two looks at a job.
POLL = 30.0


class Service(Protocol):
    """What a job needs of a service. submit() has to give the same id for the same name, so that a submission that was made but not noted isn't made twice."""

    def submit(self, name: str, requests: list[tuple[str, str]]) -> str: ...

    def ended(self, service_id: str) -> bool: ...

    def results(self, service_id: str) -> list[tuple[str, str | None, str | None]]: ...

    def cancel(self, service_id: str) -> None: ...


def batch_jobs(requests: DataFrame, connect: Callable[[], Service], poll: float = POLL, pace: float = 1.0) -> DataFrame:
    """(job, chunk_id, result, error, status) of a stream of requests (job, chunk_id, prompt, action).

    A job's first requests are submitted together; until the service has ended them, later ones wait and make the job's next submission. A job is
    looked at every poll seconds. A submission, look or collection that fails is tried again when pause_after() says, TRIES times, then its
    chunks come out with status failed; all else comes out as done, with the service's result or error. A row with action cancel cancels what was
    submitted and what waits, with status cancelled. All that is known of a job is state, so a stream that is restarted goes on where it was.
    A chunk that comes again while its job has it is left out; rows without job or chunk (but cancellations) are, too. pace scales all waits."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = key[0]
        held = list(state.get) if state.exists else ["waiting", None, 0, [], [], [], []]
        phase, service_id, attempt = held[:3]
        chunks, prompts, later, later_prompts = (list(x) for x in held[3:])
        out: list[tuple] = []

        def give(names: list[str], status: str, error: str | None) -> None:
            out.extend((job, c, None, error, status) for c in names)

        cancelled = False
        for frame in frames if not state.hasTimedOut else ():
            for row in frame.itertuples(index=False):
                cancelled = cancelled or row.action == "cancel"
                if row.chunk_id is not None and row.action != "cancel" and row.chunk_id not in chunks and row.chunk_id not in later:
                    new, texts = (later, later_prompts) if phase == "submitted" or attempt else (chunks, prompts)
                    new.append(row.chunk_id)
                    texts.append(row.prompt or "")
        wait, error = None, None
        if cancelled:
            if service_id is not None:
                try:
                    connect().cancel(service_id)
                except Exception as e:  # noqa: BLE001  a service that can't cancel changes nothing here
                    error = str(e)[:200]
            give(chunks + later, "cancelled", error)
            chunks, later = [], []
        elif phase == "submitted" and not state.hasTimedOut:
            wait = poll  # more requests came; the job is looked at next time
        elif attempt and not state.hasTimedOut:
            wait = pause_after(None, attempt)[0]
        while wait is None and chunks:
            try:
                service = connect()
                if phase == "waiting":
                    service_id, phase, attempt, wait = service.submit(f"{job}-{'-'.join(chunks)}", list(zip(chunks, prompts, strict=True))), "submitted", 0, poll
                elif not service.ended(service_id):
                    attempt, wait = 0, poll
                else:
                    told = {c: (r, e) for c, r, e in service.results(service_id)}
                    out.extend((job, c, *told.get(c, (None, "no result")), "done") for c in chunks)
                    chunks, prompts, later, later_prompts = later, later_prompts, [], []
                    phase, service_id, attempt = "waiting", None, 0
            except Exception as e:  # noqa: BLE001  whatever the service raises is data here
                attempt += 1
                wait, again = pause_after(e, attempt)
                if not again or attempt >= TRIES:
                    give(chunks, "failed", str(e)[:200])
                    chunks, prompts, later, later_prompts = later, later_prompts, [], []
                    phase, service_id, attempt, wait = "waiting", None, 0, None
        if chunks:
            state.update((phase, service_id, attempt, chunks, prompts, later, later_prompts))
            state.setTimeoutDuration(max(1, int(1000 * pace * wait)))
        else:
            state.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    rows = requests.select("job", "chunk_id", "prompt", F.coalesce("action", F.lit("submit")).alias("action"))
    ticks = requests.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()  # after a restart without new requests nothing else would make a batch, and no timer would go off
    nobody = F.when(F.col("value") < 0, F.lit(""))
    rows = rows.unionAll(ticks.select(nobody, nobody, nobody, nobody)).filter("job is not null")
    return rows.groupBy("job").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def dealt_to_jobs(chunks: DataFrame, jobs: int) -> DataFrame:
    """Requests (job, chunk_id, prompt, action) of chunks (chunk_id, prompt), in that many jobs by hash of the chunk."""
    return chunks.select(F.concat(F.lit("job-"), F.pmod(F.xxhash64("chunk_id"), F.lit(jobs)).cast("string")).alias("job"), "chunk_id", "prompt", F.lit("submit").alias("action"))
