"""A durable job queue and a rolling token budget: batch forms, and their streaming twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_ATTEMPTS, LEASE_SECONDS, WINDOW_SECONDS, TOKENS, RESERVE = 8, 180, 60, 200_000, 1_500


def retry_delay(attempts: Column) -> Column:
    """Seconds until the next attempt: doubling, from 2 to an hour."""
    return F.least(F.lit(3600), F.pow(F.lit(2.0), F.least(F.lit(12), F.greatest(F.lit(1), attempts))).cast("int"))


def replayed(events: DataFrame) -> DataFrame:
    """The queue's rows after all events (repository, operation, at, seq): the last of each pair is PENDING, and an older
    opposite one CANCELLED. One aggregate, combined before its shuffle."""
    last = events.groupBy("repository", "operation").agg(F.max(F.struct("at", "seq")).alias("e"), F.count("*").alias("enqueued"))
    top = F.max("e").over(W.partitionBy("repository"))
    return last.select("repository", "operation", F.when(F.col("e") == top, "PENDING").otherwise("CANCELLED").alias("status"), F.col("e.at").alias("at"), "enqueued")


def claimable(jobs: DataFrame, now: Column, limit: int = 1) -> DataFrame:
    """The jobs that are due, oldest first. jobs: id, status, next_attempt_at, created_at, lease_until."""
    due = (F.col("status").isin("PENDING", "RETRY") & (F.col("next_attempt_at") <= now)) | ((F.col("status") == "RUNNING") & (F.col("lease_until") < now))
    return jobs.where(due).orderBy("next_attempt_at", "created_at", "id").limit(max(1, min(20, limit)))


def finished(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs after reports (id, token, revision, ok): only a RUNNING job with that lease and revision changes."""
    j = jobs.join(results.toDF("id", "_token", "_revision", "ok"), "id", "left")
    mine = F.coalesce((F.col("status") == "RUNNING") & (F.col("lease_token") == F.col("_token")) & (F.col("revision") == F.col("_revision")), F.lit(False))
    status = F.when(~mine, F.col("status")).when(F.col("ok"), "SUCCEEDED").when(F.col("attempts") >= MAX_ATTEMPTS, "DEAD").otherwise("RETRY")
    return j.select("id", status.alias("status"), F.when(mine & (status == "RETRY"), retry_delay(F.col("attempts"))).alias("delay"))


def rolling_use(log: DataFrame, key: str | None = None) -> DataFrame:
    """Adds used: tokens of the last WINDOW_SECONDS, and fits: whether the budget holds. log: at, tokens."""
    w = W.partitionBy(*([key] if key else [])).orderBy(F.unix_seconds(F.col("at").cast("timestamp"))).rangeBetween(-WINDOW_SECONDS, 0)
    used = F.sum("tokens").over(w)
    return log.withColumn("used", used).withColumn("fits", used <= TOKENS - RESERVE)


def queue_stream(events: DataFrame) -> DataFrame:
    """Streaming twin of replayed(): a row (repository, operation, status, at) whenever a repository's state changes.
    events: repository string, operation string, at timestamp, seq long; late rows older than the state are ignored."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (None, None, None, "")
        out = []
        for f in frames:
            for r in f.sort_values(["at", "seq"]).itertuples():
                stamp = (int(r.at.value // 1000), int(r.seq))
                if now[0] is None or stamp > (now[0], now[1]):
                    if now[2] and now[2] != r.operation:
                        out.append((key[0], now[2], "CANCELLED", r.at))
                    now = (*stamp, r.operation, "PENDING")
                    out.append((key[0], r.operation, "PENDING", r.at))
        state.update(now)
        yield pd.DataFrame(out, columns=["repository", "operation", "status", "at"])

    return events.groupBy("repository").applyInPandasWithState(
        step, "repository string, operation string, status string, at timestamp", "micros long, seq long, operation string, status string", "append", "NoTimeout"
    )


def replay_dead(jobs: DataFrame, repositories: DataFrame) -> DataFrame:
    """jobs after an operator's replay: a DEAD INDEX job is PENDING again, with no attempts, if its repository still exists at
    that revision; all others stay. repositories: id, revision."""
    now = repositories.select(F.col("id").alias("repository"), F.col("revision").alias("_now"))
    again = F.coalesce((F.col("operation") == "INDEX") & (F.col("status") == "DEAD") & (F.col("_now") == F.col("revision")), F.lit(False))
    j = jobs.join(now, "repository", "left").withColumn("_again", again)
    new = {"status": F.when(F.col("_again"), "PENDING").otherwise(F.col("status")), "attempts": F.when(F.col("_again"), 0).otherwise(F.col("attempts"))}
    return j.select(*(new.get(c, F.col(c)).alias(c) for c in jobs.columns), F.col("_again").alias("replayed"))


def dispatched(jobs: DataFrame, repositories: DataFrame) -> DataFrame:
    """claimed jobs with action: index at the repository's own revision, delete where no repository of that id exists again, and
    skip (complete without work) for stale and superseded ones."""
    now = repositories.select(F.col("id").alias("repository"), F.col("revision").alias("_now"))
    index, delete = F.col("operation") == "INDEX", F.col("operation") == "DELETE"
    action = F.when(index & (F.col("_now") == F.col("revision")), "index").when(delete & F.col("_now").isNull(), "delete").when(index | delete, "skip").otherwise("unsupported")
    return jobs.join(now, "repository", "left").withColumn("action", action).drop("_now")


def budget_log(events: DataFrame, limit: int = TOKENS - RESERVE) -> DataFrame:
    """limiter, seq, granted, wait of each event of a rolling budget. events: limiter, seq, at (seconds), op, ticket, tokens.

    reserve takes tokens if they fit into the window, else says how long to wait (infinite if they never fit); finish puts
    the actual cost in a ticket's place, cancel takes it out, record adds a known cost. Events run in order of at, seq; what
    is held is one window of one limiter, however long its log.
    """
    from collections import deque

    schema = "limiter string, seq long, granted boolean, wait double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, log = None, deque()
        for f in frames:
            out = []
            for limiter, seq, at, op, ticket, tokens in zip(*(f[c] for c in ("limiter", "seq", "at", "op", "ticket", "tokens"))):
                if limiter != of:
                    of, log = limiter, deque()
                while log and at - log[0][0] >= WINDOW_SECONDS:
                    log.popleft()
                tokens = 0 if pd.isna(tokens) else max(0, int(tokens))
                granted, wait = None, None
                if op == "reserve":
                    used, wait = sum(e[1] for e in log), 0.0
                    if tokens > limit:
                        wait = float("inf")
                    elif used + tokens > limit:
                        for when, n, _ in log:
                            used -= n
                            if used + tokens <= limit:
                                wait = max(when + WINDOW_SECONDS - at, 0.001)
                                break
                    granted = wait == 0
                    if granted:
                        log.append((at, tokens, ticket))
                elif op == "record":
                    log.append((at, tokens, None))
                else:
                    for i, (when, _, held) in enumerate(log):
                        if held is not None and held == ticket:
                            if op == "finish":
                                log[i] = (when, tokens, None)
                            else:
                                del log[i]
                            break
                out.append((limiter, seq, granted, wait))
            yield pd.DataFrame(out, columns=["limiter", "seq", "granted", "wait"])

    own = events.select(F.col("limiter").cast("string"), F.col("seq").cast("long"), F.col("at").cast("double"), "op", F.col("ticket").cast("string"), F.col("tokens").cast("long"))
    return own.repartition("limiter").sortWithinPartitions("limiter", "at", "seq").mapInPandas(run, schema)
