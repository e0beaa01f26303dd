"""Problem 8: token ids of whole texts with a public tokenizer. Problem 9: texts into containers of fixed capacity."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import default_vocabulary, encoder
from .common import durable, spread

CAPACITY = 2048
SLICE = 256  # rows turned into ids at a time, to bound a worker's memory


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids): ids of the text without special tokens; the empty list for null and for empty texts. Texts are encoded whole."""
    path = vocabulary or default_vocabulary()
    src = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                flat, offsets = [], [0]
                for t in part.column(1).to_pylist():
                    ids = enc.encode(t)
                    flat.append(ids)
                    offsets.append(offsets[-1] + len(ids))
                values = pa.array(memoryview(b"".join(a.tobytes() for a in flat)).cast("i") if offsets[-1] else [], pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [id_col, "ids"])

    kind = src.schema[id_col].dataType.simpleString()
    return spread(src).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n): number of tokens of each text, by the same encoder; only the counts leave the worker."""
    path = vocabulary or default_vocabulary()
    src = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            n = pa.array([len(enc.encode(t.as_py())) for t in batch.column(1)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], [id_col, "n"])

    kind = src.schema[id_col].dataType.simpleString()
    return spread(src).mapInArrow(run, f"`{id_col}` {kind}, n int")


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: rows (length, first rank, items, first container, items per container).

    Items of one length with ranks first..first+items-1 go to container first_container + (rank - first) // per. Containers in
    the same state form one group, so the plan's size depends on the number of different lengths, not on the number of items.
    """
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs (first container, containers)
    present = [False] * (capacity + 1)
    fresh = 0
    rows: list[tuple[int, int, int, int, int]] = []

    def put(room: int, start: int, n: int) -> None:
        if n:
            groups[room].append((start, n))
            present[room] = True

    for length in sorted((x for x in histogram if 0 < x <= capacity), reverse=True):
        left, rank = histogram[length], 0
        room = length
        while left:
            while room <= capacity and not present[room]:
                room += 1
            if room > capacity:
                break
            start, n = groups[room].pop()
            present[room] = bool(groups[room])
            per = room // length
            whole = min(n, left // per) if per else 0
            if whole:
                rows.append((length, rank, whole * per, start, per))
                put(room - per * length, start, whole)
                rank, left, start, n = rank + whole * per, left - whole * per, start + whole, n - whole
            if n and left:  # fewer items than one container's worth
                rows.append((length, rank, left, start, left))
                put(room - left * length, start, 1)
                start, n, left = start + 1, n - 1, 0
            put(room, start, n)
            if n == 0 and not groups[room]:
                present[room] = False
        if left:
            per = capacity // length
            whole = left // per
            if whole:
                rows.append((length, rank, whole * per, fresh, per))
                put(capacity - per * length, fresh, whole)
                rank, left, fresh = rank + whole * per, left - whole * per, fresh + whole
            if left:
                rows.append((length, rank, left, fresh, left))
                put(capacity - left * length, fresh, 1)
                fresh += 1
    if histogram.get(0):
        rows.append((0, 0, histogram[0], 0, histogram[0]))
    return rows


def ranked(items: DataFrame, key: str, order: str, per_bucket: int = 100_000) -> DataFrame:
    """0-based rank within key without gathering a key in one task: rows are numbered inside salted buckets, buckets are offset by
    prefix sums of their counts. items must be durable, as it is read twice."""
    n = items.count()
    buckets = max(8, n // per_bucket)
    b = items.withColumn("_b", F.pmod(F.xxhash64(order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = b.groupBy(key, "_b").agg(F.count("*").alias("_c")).withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = F.row_number().over(Window.partitionBy(key, "_b").orderBy(order, "_s")) - 1
    return b.withColumn("_s", F.monotonically_increasing_id()).withColumn("_i", inside).drop("_s").join(offsets, [key, "_b"]).withColumn("rank", F.col("_off") + F.col("_i")).drop("_b", "_off", "_i")


def containers(counts: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", n_col: str = "n") -> DataFrame:
    """(id, piece, n_tokens, container): where each item goes. An item longer than the capacity is cut into pieces of the capacity
    and one rest; a shorter item is never cut. Items of no tokens share container 0. Null sizes count as 0. Containers are numbered
    from 0, those planned first, then those of full pieces."""
    spark = counts.sparkSession
    src = counts.select(F.col(id_col).alias("id"), F.coalesce(F.col(n_col), F.lit(0)).cast("long").alias("n"))
    full = F.when(F.col("n") > capacity, F.floor(F.col("n") / capacity)).otherwise(F.lit(0)).cast("long")
    src = durable(src.withColumn("full", full).withColumn("rest", (F.col("n") - F.col("full") * capacity).cast("int")))
    # items that end exactly with a full piece have no rest of their own
    items = src.filter("rest > 0 or full = 0").select("id", "full", F.col("rest").alias("length"))
    histogram = {r["length"]: r["c"] for r in items.groupBy("length").agg(F.count("*").alias("c")).collect()}  # at most capacity + 1 rows
    plan = plan_slots(histogram, capacity)
    used = max((c + (k - 1) // per for _, _, k, c, per in plan), default=-1) + 1
    slots = spark.createDataFrame(plan or [(-1, 0, 0, 0, 1)], "length int, first long, items long, start long, per long")
    placed = (
        ranked(items, "length", "id")
        .join(F.broadcast(slots), "length")  # a few rows per length: bounded by the capacity
        .filter("rank >= first and rank < first + items")
        .select("id", F.col("full").cast("int").alias("piece"), F.col("length").alias("n_tokens"), (F.col("start") + F.floor((F.col("rank") - F.col("first")) / F.col("per"))).cast("long").alias("container"))
    )
    # full pieces: a container each, numbered by prefix sums over salted buckets
    long_items = src.filter("full > 0")
    b = long_items.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(1024)).cast("int"))
    base = b.groupBy("_b").agg(F.sum("full").alias("_c")).withColumn("_off", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    run = Window.partitionBy("_b").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    whole = (
        b.withColumn("_i", F.coalesce(F.sum("full").over(run), F.lit(0)))
        .join(F.broadcast(base), "_b")  # 1,024 rows
        .select("id", (F.lit(used) + F.col("_off") + F.col("_i")).alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"))
        .select("id", F.col("piece").cast("int").alias("piece"), F.lit(capacity).alias("n_tokens"), (F.col("at") + F.col("piece")).cast("long").alias("container"))
    )
    return placed.unionByName(whole).withColumnRenamed("id", id_col)
