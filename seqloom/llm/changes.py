"""Sequenced change application by a bucket-keyed timing wheel.

Changes carry a sequence number per client and arrive in batches, late and out of
order.  A change whose number is due is applied; one that is early is held until the
numbers before it come or its patience ends, and then the client jumps over the gap.

A stateful Structured Streaming query does this, keyed by a bucket of clients.  A
bucket's state is a timing wheel: expiry day -> clients whose earliest held change
expires then.  A batch brings every bucket a tick (the largest day of all earlier
batches); only slots that are due are visited, and each client that was touched is put
into the slot of its new earliest day.  Within a batch the outcome doesn't depend on
more than which change of a number comes first, so each client costs a sort.
"""

from __future__ import annotations

import heapq
import math
import pickle
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .stash import shared_folder, stash

#: Days that a held change waits for the numbers before it.
PATIENCE = 3
#: The day of the first batch, its number of days and the number of batches.
FIRST_DAY, SPAN, BATCHES = 19723, 160, 12
#: Sequence numbers are ranked in blocks of so many, which bounds a window's group whatever one client holds.
BLOCK = 128
#: Changes per bucket: the number of buckets grows with the input.
BUCKET_ROWS = 20_000

#: A change or, with control, the tick of a bucket. `known` tells a client of null from client 0.
FEED = "bucket long, control boolean, batch int, tick long, flush boolean, change_id long, client_id long, known boolean, n long, day long, op string, city string, balance double"
EVENT = "kind string, change_id long, client_id long, known boolean, n long, batch int, missed long, city string, cents long"
RESULT = "change_id long, client_id long, status string, batch int, missed long, city string, cents long, current boolean"
STATE = "bucket binary"


class Wheel:
    """The state of one bucket.  Clients are (known, client_id)."""

    def __init__(self) -> None:
        self.slots: dict[int, set] = {}  #: expiry day -> clients
        self.due: dict[tuple, int] = {}  #: client -> the slot it is in
        self.held: dict[tuple, dict[int, tuple]] = {}  #: client -> number -> (day, change_id, op, city, balance)
        self.rows: dict[tuple, list] = {}  #: client -> [next number, city, balance, last change, its number, whether it stands]

    def dump(self) -> bytes:
        return pickle.dumps((self.slots, self.due, self.held, self.rows), protocol=5)

    @classmethod
    def load(cls, data: bytes) -> Wheel:
        wheel = cls()
        wheel.slots, wheel.due, wheel.held, wheel.rows = pickle.loads(data)
        return wheel

    def reschedule(self, client: tuple) -> None:
        """Put a client into the slot of its earliest held day."""
        held = self.held.get(client)
        slot = min(x[0] for x in held.values()) + PATIENCE if held else None
        old = self.due.get(client)
        if slot == old:
            return
        if old is not None:
            self.slots[old].discard(client)
            if not self.slots[old]:
                del self.slots[old]
        if slot is None:
            del self.due[client]
            self.held.pop(client, None)
        else:
            self.due[client] = slot
            self.slots.setdefault(slot, set()).add(client)

    def apply(self, client: tuple, n: int, missed: int, batch: int) -> tuple:
        """Take the held change n, which is due, and move on."""
        row = self.rows[client]
        _, change, op, city, balance = self.held[client].pop(n)
        if op == "I":
            row[1], row[2] = city, balance
        elif op == "U":
            row[1], row[2] = row[1] if city is None else city, row[2] if balance is None else balance
        elif op == "D":
            row[1] = row[2] = None
        row[0], row[3], row[4], row[5] = n + 1, change, n, op != "D"
        return ("applied", change, client[1], client[0], n, batch, missed, row[1], None if row[2] is None else math.floor(100 * row[2] + 0.5))

    def run(self, client: tuple, batch: int) -> Iterator[tuple]:
        """Apply what is due without a gap."""
        held = self.held.get(client)
        while held and self.rows[client][0] in held:
            yield self.apply(client, self.rows[client][0], 0, batch)

    def jump(self, client: tuple, tick: int | None, batch: int) -> Iterator[tuple]:
        """While the earliest held change has expired (tick None: always), go on from the smallest held number."""
        held = self.held[client]
        order, days, at = sorted(held), [(x[0], n) for n, x in held.items()], 0
        heapq.heapify(days)
        while held:
            while days[0][1] not in held:
                heapq.heappop(days)
            if tick is not None and days[0][0] + PATIENCE > tick:
                break
            while order[at] not in held:
                at += 1
            n = order[at]
            yield self.apply(client, n, n - self.rows[client][0], batch)
            yield from self.run(client, batch)

    def tick(self, day: int | None, batch: int, flush: bool = False) -> Iterator[tuple]:
        """Visit the slots that are due by a day; with flush all of them."""
        for slot in sorted(x for x in self.slots if flush or (day is not None and x <= day)):
            for client in sorted(self.slots.get(slot, ())):
                yield from self.jump(client, None if flush else day, batch)
                self.reschedule(client)

    def arrive(self, client: tuple, changes: list[tuple], batch: int) -> Iterator[tuple]:
        """A batch's changes (day, change_id, n, op, city, balance) of one client."""
        row = self.rows.setdefault(client, [1, None, None, None, None, False])
        held = self.held.setdefault(client, {})
        for day, change, n, op, city, balance in sorted(changes, key=lambda x: (x[0], x[1], str(x[2:]))):
            if n in held or n < row[0]:
                yield ("rejected", change, client[1], client[0], n, batch, 0, None, None)
            else:
                held[n] = (day, change, op, city, balance)
                yield from self.run(client, batch)
        if not held:
            del self.held[client]
        if client in self.due or held:
            self.reschedule(client)

    def last(self, batch: int) -> Iterator[tuple]:
        """The final change of each client that still stands."""
        for client, row in self.rows.items():
            if row[5]:
                yield ("last", row[3], client[1], client[0], row[4], batch, 0, None, None)


def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One bucket's batch: its tick first, then its changes; after the last batch what still waits."""
    wheel = Wheel.load(state.get[0]) if state.exists else Wheel()
    tick: dict[str, Any] | None = None
    changes: dict[tuple, list[tuple]] = {}
    batch = 0
    for frame in frames:
        control = frame["control"].to_numpy(bool)
        for r in frame[control].itertuples():
            tick = {"day": r.tick if pd.notna(r.tick) else None, "flush": bool(r.flush)}
        frame = frame[~control]
        batch = int(frame["batch"].iloc[0]) if len(frame) else batch
        values = (frame[c].tolist() for c in ("known", "client_id", "day", "change_id", "n", "op", "city", "balance"))
        for known, client, day, change, n, op, city, balance in zip(*values, strict=True):
            changes.setdefault((known, client), []).append((day, change, n, op, city, None if balance != balance else balance))
        if tick is not None and not batch:
            batch = int(r.batch)
    out: list[tuple] = []
    if tick is not None:
        out += wheel.tick(tick["day"] if tick["day"] is None else int(tick["day"]), batch, tick["flush"])
    for client, own in changes.items():
        out += wheel.arrive(client, own, batch)
    if tick is not None and tick["flush"]:
        out += wheel.last(batch)
    state.update((wheel.dump(),))
    if out:
        table = pd.DataFrame(out, columns=[c.split()[0] for c in EVENT.split(", ")])
        table["cents"] = table["cents"].astype("Int64")
        yield table


def numbered(changes: DataFrame) -> DataFrame:
    """The distinct changes with n (the dense rank of seq within the client), day and batch.

    Ranks are taken within blocks of BLOCK numbers, to which the sizes of the client's
    earlier blocks are added, so that no window holds more than a block's numbers and
    their repeats.  A null seq is a number of its own before all others.
    """
    rows = changes.select(
        F.col("change_id").cast("long").alias("change_id"),
        F.col("client_id").cast("long").alias("client_id"),
        F.col("seq").cast("long").alias("seq"),
        *(F.col(c) for c in changes.columns if c not in ("change_id", "client_id", "seq")),
    ).distinct()
    rows = rows.select("change_id", "client_id", "seq", F.col("op").cast("string").alias("op"), "valid_at", F.col("city").cast("string").alias("city"), F.col("balance").cast("double").alias("balance"))
    rows = rows.withColumn("block", F.floor(F.col("seq") / BLOCK)).withColumn("rank", F.dense_rank().over(Window.partitionBy("client_id", "block").orderBy(F.col("seq").asc_nulls_first())))
    sizes = rows.groupBy("client_id", "block").agg(F.max("rank").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("client_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("client_id").alias("c"), F.col("block").alias("b"), before.alias("before"))
    rows = rows.join(sizes, F.col("client_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    h = F.crc32(F.col("change_id").cast("string"))
    day = F.datediff(F.col("valid_at").cast("date"), F.lit("1970-01-01").cast("date")) + 9 * (h % 4)
    batch = F.greatest(F.lit(1), F.least(F.lit(BATCHES), 1 + F.floor((F.col("day") - FIRST_DAY) * BATCHES / F.lit(SPAN)))).cast("int")
    kept = rows.where("valid_at is not null and change_id is not null").where(h % 11 != 0)
    return kept.select("change_id", "client_id", (F.col("before") + F.col("rank")).cast("long").alias("n"), day.cast("long").alias("day"), "op", "city", "balance").withColumn("batch", batch)


def fed(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows of numbered changes as the stream takes them; client 0 stands for a null one, told apart by `known`."""
    number = (F.abs("balance") < float("inf")) & ~F.isnan("balance")
    own = {
        "bucket": F.pmod(F.xxhash64("client_id"), F.lit(buckets)),
        "control": F.lit(False),
        "flush": F.lit(False),
        "client_id": F.coalesce("client_id", F.lit(0)),
        "known": F.col("client_id").isNotNull(),
        "tick": F.lit(None),
        "balance": F.when(number, F.col("balance")),
    }
    return rows.select(*(own.get(c, F.col(c)).cast(kind).alias(c) for c, kind in (x.split() for x in FEED.split(", "))))


def ticks(spark: SparkSession, buckets: int, batch: int, day: int | None) -> DataFrame:
    """A control row for every bucket."""
    own = {"bucket": F.col("id"), "control": F.lit(True), "batch": F.lit(batch), "tick": F.lit(day), "flush": F.lit(batch > BATCHES), "known": F.lit(False)}
    empty = {"op": F.lit(None), "city": F.lit(None), "balance": F.lit(None)}
    return spark.range(buckets).select(*((own | empty).get(c, F.lit(0)).cast(kind).alias(c) for c, kind in (x.split() for x in FEED.split(", "))))


def apply_changes(changes: DataFrame) -> DataFrame:
    """One row per distinct change: change_id, client_id, status (applied or rejected), the
    batch where that happened, missed (numbers jumped right before it), city and cents
    afterwards, and current (the client's last applied change, unless it deletes).

    Changes without valid_at or change_id, and those whose crc32 is a multiple of 11,
    take part in nothing but the numbering.  A null client_id is a client of its own; a
    null seq comes before all others; an op other than I, U and D is applied and changes
    nothing; a balance that isn't a number counts as null.  Of changes with one number
    the first by day and change_id (then by content) is held.  Days before the first
    batch's belong to it.  Repeated rows count once, as long as no column differs; extra
    columns take part in that alone.  An empty table gives an empty result.

    Every batch is written to a folder of its own call and fed to a streaming query that
    starts anew on one checkpoint, so a driver or an executor that is lost costs a batch.
    A bucket's state holds its clients' rows and what they hold back; the changes of one
    client in one batch meet in one task, as their order matters.
    """
    spark = changes.sparkSession
    rows = stash(numbered(changes), "changes")
    largest = {r["batch"]: (r["day"], r["n"]) for r in rows.groupBy("batch").agg(F.max("day").alias("day"), F.count(F.lit(1)).alias("n")).collect()}  # at most BATCHES rows
    if not largest:
        return spark.createDataFrame([], RESULT)
    buckets = max(64, sum(n for _, n in largest.values()) // BUCKET_ROWS)
    root = f"{shared_folder(spark)}/changes-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    feed = fed(rows, buckets)
    tick = None
    for batch in range(1, BATCHES + 2):
        ticks(spark, buckets, batch, tick).unionByName(feed.where(F.col("batch") == batch)).write.mode("append").parquet(f"{root}/feed")
        step(spark, root)
        tick = max([x for x in (tick, largest.get(batch, (None,))[0]) if x is not None], default=None)
    events = spark.read.schema(EVENT).parquet(f"{root}/events")
    client = F.when(F.col("known"), F.col("client_id")).alias("client_id")
    last = events.where("kind = 'last'").select(F.col("change_id").alias("last_id"), F.col("client_id").alias("last_client"), F.col("known").alias("last_known"), F.col("n").alias("last_n"))
    same = (F.col("change_id") == F.col("last_id")) & (F.col("client_id") == F.col("last_client")) & (F.col("known") == F.col("last_known")) & (F.col("n") == F.col("last_n")) & (F.col("kind") == "applied")
    return events.where("kind <> 'last'").join(last, same, "left").select("change_id", client, F.col("kind").alias("status"), "batch", "missed", "city", "cents", F.col("last_id").isNotNull().alias("current"))


def step(spark: SparkSession, root: str) -> None:
    """Start the query on its checkpoint for what has been fed since, and wait for it."""
    events = spark.readStream.schema(FEED).parquet(f"{root}/feed").groupBy("bucket").applyInPandasWithState(advance, EVENT, STATE, "append", GroupStateTimeout.NoTimeout)
    query = events.writeStream.format("parquet").option("path", f"{root}/events").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
