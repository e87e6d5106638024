"""A keyed journal kept from a stream: upserts, deletions and retention in state, unreadable lines beside it.

The state of an owner holds the newest ids by the number of their last change,
deleted ones included, so it is bounded, and the order in which changes arrive
doesn't matter. Changes and unreadable lines are written per micro-batch under
the batch's number; a batch that runs again after a restart replaces what it
wrote before, so each change counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

CHANGES = "owner string, id string, seq long, payload string, live boolean"


class Newest(StatefulProcessor):
    """Of each owner the ``n`` ids with the newest last change; reports every id whose record changed, was deleted or had to go.

    An owner's records are one value, read and written once a batch: a call for
    each record costs more than all else.
    """

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.records = handle.getValueState("records", "ids array<string>, seqs array<long>, payloads array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        stored = self.records.get()
        held = {i: (seq, payload) for i, seq, payload in zip(*stored)} if stored is not None else {}
        before = dict(held)
        for _, i, seq, payload in rows:
            if i not in held or seq > held[i][0]:
                held[i] = (seq, payload)
                if len(held) > 2 * self.n:
                    held = self._newest(held)
        held = self._newest(held)
        changed = [i for i in {**before, **held} if held.get(i) != before.get(i)]
        if changed:
            self.records.update((list(held), [v[0] for v in held.values()], [v[1] for v in held.values()]))
        for i in changed:
            yield Row(owner=key[0], id=i, seq=held.get(i, before.get(i))[0], payload=held.get(i, before.get(i))[1], live=i in held and held[i][1] is not None)

    def _newest(self, held: dict) -> dict:
        return dict(sorted(held.items(), key=lambda x: (-x[1][0], x[0]))[: self.n])

    def close(self) -> None:
        pass


def parsed(lines: DataFrame) -> DataFrame:
    """``owner, id, seq, payload, line`` of JSON ``value``s; the payload is null for a deletion, the id for a line that isn't a change."""
    v = F.from_json("value", "owner string, id string, seq long, op string, payload string", {"mode": "PERMISSIVE"})
    own = lines.where(F.trim("value") != "").select(F.col("value").alias("line"), v.alias("v"))
    good = (F.col("v.owner") != "") & (F.col("v.id") != "") & F.col("v.seq").isNotNull() & F.col("v.op").isin("put", "delete")
    keep = lambda c: F.when(F.coalesce(good, F.lit(False)), c)
    payload = F.when(F.col("v.op") == "put", F.coalesce("v.payload", F.lit("")))
    return own.select(keep(F.col("v.owner")).alias("owner"), keep(F.col("v.id")).alias("id"), keep(F.col("v.seq")).alias("seq"), keep(payload).alias("payload"), "line")


def keep(lines: DataFrame, root: str, n: int, **trigger) -> list[StreamingQuery]:
    """Starts the journal below ``root`` from a stream of lines: one query keeps records, one sets unreadable lines aside."""
    rows = parsed(lines)
    changes = rows.where("id IS NOT NULL").select("owner", "id", "seq", "payload").groupBy("owner").transformWithState(Newest(n), CHANGES, "Update", "None")

    def to(folder: str, df: DataFrame, mode: str) -> StreamingQuery:
        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{root}/{folder}/batch={number}")

        return df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/state-{folder}").trigger(**(trigger or {"availableNow": True})).start()

    bad = rows.where("id IS NULL").select(F.sha2("line", 256).alias("digest"), "line")
    return [to("changes", changes, "update"), to("unreadable", bad, "append")]


def kept(spark: SparkSession, root: str) -> DataFrame:
    """``owner, id, seq, payload`` of the records there are now: the last change of each that isn't a deletion."""
    last = F.row_number().over(Window.partitionBy("owner", "id").orderBy(F.desc("batch")))
    changes = spark.read.schema(f"{CHANGES}, batch long").parquet(f"{root}/changes")
    return changes.withColumn("_n", last).where("_n = 1 AND live").select("owner", "id", "seq", "payload")


def unreadable(spark: SparkSession, root: str) -> DataFrame:
    """``digest, line`` of unreadable lines, each content once."""
    return spark.read.schema("digest string, line string, batch long").parquet(f"{root}/unreadable").select("digest", "line").dropDuplicates(["digest"])
