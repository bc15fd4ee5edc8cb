"""The limit of active rules over a log that comes day by day.

What is kept of an owner from one day to the next is one row: the rules that are
active, ``limit`` of them at most, and how far its log was read. So a day's work is that day's log,
however long the history is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .rules import ACTIVE_LIMIT, LOG

STATE = "tenant_id string, owner_subject string, active array<string>, last_seq bigint"
FOLDED = "tenant_id string, owner_subject string, alert_rule_id string, seq bigint, enable boolean, admitted boolean, active array<string>"


def no_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def _fold_batches(limit: int):
    """Rows sorted by owner, an owner's state before its log: each log row with its answer, and after them the owner's new state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tenant_id", pa.string()), ("owner_subject", pa.string()), ("alert_rule_id", pa.string()), ("seq", pa.int64()), ("enable", pa.bool_()), ("admitted", pa.bool_()), ("active", pa.list_(pa.string()))])
        owner, active, last, read = None, set(), None, None

        def state() -> tuple:
            return (*owner, None, read, None, None, sorted(active))

        for batch in batches:
            out: list[tuple] = []
            for tenant, subject, rule, seq, enable, held in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (tenant, subject) != owner:
                    if owner is not None:
                        out.append(state())
                    owner, active, last, read = (tenant, subject), set(), None, None
                if held is not None:
                    active, last, read = set(held), seq, seq
                    continue
                if last is not None and seq <= last:
                    continue
                fits = not enable or rule in active or len(active) < limit
                if enable and fits:
                    active.add(rule)
                elif not enable:
                    active.discard(rule)
                read = seq
                out.append((tenant, subject, rule, seq, enable, fits, None))
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)
        if owner is not None:
            yield pa.record_batch([pa.array([v], f.type) for v, f in zip(state(), schema, strict=True)], schema=schema)

    return run


def folded(log: DataFrame, state: DataFrame, limit: int = ACTIVE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(rows with ``admitted``, new state) of a part of the log on top of a stored state, a row an owner.

    Rows up to an owner's stored position were answered before and are left out, so a
    part that is sent again changes nothing. Rows of one position must come in one part.
    Owners without new rows keep their state. The log of an owner passes one task in order, which
    holds ``limit`` rules of it; owners are spread over all tasks.
    """
    none = lambda kind: F.lit(None).cast(kind)
    start = state.select(
        "tenant_id", "owner_subject", none("string").alias("alert_rule_id"), F.col("last_seq").alias("seq"), none("boolean").alias("enable"), "active", F.lit(0).alias("turn")
    )
    rows = log.select(*LOG, none("array<string>").alias("active"), F.lit(1).alias("turn"))
    dealt = start.unionByName(rows).repartition("tenant_id", "owner_subject").sortWithinPartitions("tenant_id", "owner_subject", "turn", "seq", "alert_rule_id")
    done = materialise(dealt.select(*LOG, "active").mapInArrow(_fold_batches(limit), FOLDED), "folded")
    new = done.where("active IS NOT NULL").select("tenant_id", "owner_subject", "active", F.col("seq").alias("last_seq"))
    return done.where("active IS NULL").drop("active"), new
