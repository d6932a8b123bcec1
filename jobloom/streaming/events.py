"""Payment events as a stream: delivered at least once, fulfilled once. An extension: the batch form is operators.fulfil.

Sessions are the key of Spark's own stateful deduplication: the state store remembers a session for `REMEMBERED` after it was
let through, so repeats and rival events of a session end there and reach no table; of several in one micro-batch the first
by (paid_at, event_id) is let through. The watermark runs on the time of arrival, so no event is ever too late, and the state
is bounded by what arrives in that time, however long the stream runs. What the state has forgotten, or a new checkpoint
never knew, is compared with the payments in the tables, as in the batch form.

Each micro-batch is one commit over the three tables that also notes the batch's number, so a batch that is run again after
a crash, before or after its commit, writes its rows once.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from jobloom.operators import fulfil
from jobloom.sources.shared import materialize
from jobloom.sources.store import TableStore, Transaction

EVENT_SCHEMA = (
    "event_id string, type string, session_id string, amount_total bigint, currency string, metadata map<string,string>, paid_at bigint"
)
#: How long the state knows a session after it was let through, in ms: longer than a sender repeats a delivery.
REMEMBERED = 7 * 86_400_000


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).json(folder)


def _first_rows(rows: pa.Table) -> pa.Table:
    """The first row of each session by (paid_at, event_id)."""
    order = pc.sort_indices(rows.select(["session_id", "paid_at", "event_id"]), [(c, "ascending") for c in ("session_id", "paid_at", "event_id")])
    own = pc.dictionary_encode(rows["session_id"].combine_chunks().take(order), null_encoding="encode")
    own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
    starts = pc.not_equal(own.indices[1:], own.indices[:-1])
    return rows.take(order.filter(pa.concat_arrays([pa.array([True]), starts])))


def first_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each session in a task's rows; they are reduced each time they have doubled."""
    held, rows, least = [], 0, 20_000
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= least:
            held = _first_rows(pa.Table.from_batches(held)).to_batches()
            rows = sum(h.num_rows for h in held)
            least = max(20_000, 2 * rows)
    if rows:
        yield from _first_rows(pa.Table.from_batches(held)).to_batches(max_chunksize=10_000)


def first_of_sessions(payments: DataFrame, remembered_ms: int = REMEMBERED) -> DataFrame:
    """Of a stream of payments (fulfil.payment_fields) the first of each session; later ones are let through no more.

    Payments without a session are one session, that of null. The order within a micro-batch is settled by its rows of a
    session being brought together, whatever the state then lets through is one row of each.
    """
    first = payments.repartition("session_id").mapInArrow(first_of_batch, payments.schema)
    arriving = first.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", f"{remembered_ms} milliseconds")
    return arriving.dropDuplicatesWithinWatermark(["session_id"]).drop("arrived")


def fulfil_batch(store: TableStore, payments: DataFrame, stream: str = "", number: int = -1) -> dict[str, int]:
    """Fulfils one batch of payments as one commit, which notes the stream's batch number; a batch noted before writes nothing."""
    own = materialize(payments.filter("error IS NULL"), "payments")
    if own.isEmpty():
        return {}

    def work(t: Transaction) -> dict[str, int]:
        if stream and t.base_notes.get(stream, -1) >= number:
            return {}
        if stream:
            t.notes[stream] = number
        return fulfil.into(t, own)

    return store.transact(work)


def fulfil_stream(store: TableStore, events: DataFrame, checkpoint: str, remembered_ms: int = REMEMBERED) -> DataStreamWriter:
    """A writer that fulfils each micro-batch; the caller starts it."""

    def each(batch: DataFrame, number: int) -> None:
        # In a thread of its own: on the connection that calls back from the JVM each of the many calls that make a plan
        # waits for a delayed acknowledgement.
        with ThreadPoolExecutor(1) as own:
            own.submit(fulfil_batch, store, batch, f"stream {checkpoint}", number).result()

    payments = fulfil.payment_fields(events).filter("error IS NULL")
    return first_of_sessions(payments, remembered_ms).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
