"""Matching and pairing joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from padlens.functions.shared import written

#: Order in which actions take contacts.
PRIORITY = {"keystroke": 0, "pinch": 1, "swipe": 2, "scroll": 3, "tap": 4}
#: What a label's row says.
ACCEPTED, RESERVED, UNMATCHED = "accepted", "raw_contact_reserved_by_higher_priority_event", "no_matching_complete_raw_contact"


def candidates(labels: DataFrame, contacts: DataFrame, tolerance: int, margin: int) -> DataFrame:
    """Contacts that a label may take, with the match score. Equal user, session and activity; by action:
    both ends within the tolerance; or start within it and end from end - tolerance to end + margin (scroll); or the
    contact around the label with at most twice the margin to spare (pinch).

    labels(event_id, user_id, session_id, act_id, action, start_ms, end_ms, x0, y0, x1, y1), contacts(contact_id, same keys and ends).
    """
    a = labels.alias("a")
    b = contacts.select("user_id", "session_id", "act_id", "contact_id", *[F.col(c).alias(f"c_{c}") for c in ("start_ms", "end_ms", "x0", "y0", "x1", "y1")])
    j = a.join(b, ["user_id", "session_id", "act_id"])
    ds, de = F.abs(F.col("c_start_ms") - F.col("start_ms")), F.abs(F.col("c_end_ms") - F.col("end_ms"))
    scroll = (ds <= tolerance) & (F.col("c_end_ms") >= F.col("end_ms") - tolerance) & (F.col("c_end_ms") - F.col("end_ms") <= margin)
    spare = F.greatest(F.col("start_ms") - F.col("c_start_ms"), F.lit(0)) + F.greatest(F.col("c_end_ms") - F.col("end_ms"), F.lit(0))
    pinch = (F.col("c_start_ms") <= F.col("start_ms") + tolerance) & (F.col("c_end_ms") >= F.col("end_ms") - tolerance) & (spare <= 2 * margin)
    fits = F.when(F.col("action") == "scroll", scroll).when(F.col("action") == "pinch", pinch).otherwise((ds <= tolerance) & (de <= tolerance))
    way = F.hypot(F.col("c_x0") - F.col("x0"), F.col("c_y0") - F.col("y0")) + F.hypot(F.col("c_x1") - F.col("x1"), F.col("c_y1") - F.col("y1"))
    return j.filter(fits).withColumn("score", ds + de + 0.01 * F.coalesce(way, F.lit(0.0))).select(
        "user_id", "session_id", "event_id", "action", "start_ms", "end_ms", "contact_id", "score", F.col("c_start_ms").alias("contact_ms")
    )


def stretches(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels(user_id, session_id, event_id, ...) with `stretch`, a number within the session: labels that share a contact, or
    whose contacts lie between those of others, have the same one.

    A label covers the time from its first to its last candidate's start; where no label covers the next one's first
    candidate, the running maximum of last starts lies below it and a new stretch begins. Labels without candidates share 0.
    """
    key = ["user_id", "session_id"]
    span = found.groupBy(*key, "event_id").agg(F.min("contact_ms").alias("_lo"), F.max("contact_ms").alias("_hi"))
    order = Window.partitionBy(*key).orderBy("_lo", "event_id")
    opens = F.col("_lo") > F.coalesce(F.max("_hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_lo") - 1)
    marked = span.withColumn("_new", opens.cast("long")).select(*key, "event_id", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("stretch"))
    return labels.join(marked, [*key, "event_id"], "left").fillna(0, ["stretch"])


def assign(labels: DataFrame, found: DataFrame) -> DataFrame:
    """One contact at most for each label and one label for each contact, taken greedily within a session by
    action priority, then start and end; each takes the least (score, contact_id) still free. Labels left over say why.

    The order matters, so labels that can compete for a contact, a session's stretch, are read in it by one task. Stretches are
    small and many: a task reads all of its own in one sorted run, holding a stretch's taken contacts and no more. Labels without
    candidates need none of this.
    """
    key = ["user_id", "session_id"]
    placed = stretches(labels.select(*key, "event_id", "action", "start_ms", "end_ms"), found)
    alone = placed.filter("stretch = 0").select("event_id", F.lit(None).cast("long").alias("contact_id"), F.lit(None).cast("double").alias("score"), F.lit(UNMATCHED).alias("status"))
    rows = placed.filter("stretch > 0").join(found.select(*key, "event_id", "contact_id", "score"), [*key, "event_id"], "left")
    priority = F.coalesce(F.create_map(*[F.lit(v) for pair in PRIORITY.items() for v in pair])[F.col("action")], F.lit(len(PRIORITY)))
    group, label = [*key, "stretch"], ["priority", "start_ms", "end_ms", "event_id"]
    rows = rows.withColumn("priority", priority).select(*group, *label, "score", "contact_id")
    rows = rows.repartition(*group).sortWithinPartitions(*group, *label, "score", "contact_id")
    names = ["event_id", "contact_id", "score", "status"]

    def send(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within = at = held = None
        taken: set[int] = set()
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in (*group, *label, "score", "contact_id")]
            for user, session, stretch, rank, start, end, event, score, contact in zip(*columns):
                if within != (user, session, stretch):
                    within, taken = (user, session, stretch), set()
                if at != (within, rank, start, end, event):
                    if held:
                        out.append(held)
                    at, held = (within, rank, start, end, event), (event, None, None, UNMATCHED)
                if contact is None or held[3] == ACCEPTED:
                    continue
                if contact in taken:
                    held = (event, None, None, RESERVED)
                else:
                    taken.add(contact)
                    held = (event, contact, score, ACCEPTED)
            yield send(out)
        if held:
            yield send([held])

    return rows.mapInArrow(walk, "event_id long, contact_id long, score double, status string").unionByName(alone)


def largest_stretch(labels: DataFrame, found: DataFrame) -> DataFrame:
    """J3's largest group: `labels, sessions, stretches, largest`."""
    size = stretches(labels, found).filter("stretch > 0").groupBy("user_id", "session_id", "stretch").agg(F.count("*").alias("n"))
    return size.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("labels"), F.countDistinct("user_id", "session_id").alias("sessions"), F.count("*").alias("stretches"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def pair_index(left: DataFrame, right: DataFrame, on: list[str], chunk: str) -> DataFrame:
    """One row of left to the chunks of right by identity; status ok, left_only, right_only or broken (chunks not 0..n-1)."""
    n = right.groupBy(*on).agg(F.count("*").alias("n_chunks"), F.min(chunk).alias("_lo"), F.max(chunk).alias("_hi"), F.countDistinct(chunk).alias("_d"))
    j = left.select(*on, F.lit(1).alias("_l")).join(n, on, "full_outer")
    whole = (F.col("_lo") == 0) & (F.col("_hi") == F.col("n_chunks") - 1) & (F.col("_d") == F.col("n_chunks"))
    status = F.when(F.col("n_chunks").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(whole, "ok").otherwise("broken")
    return j.select(*on, "n_chunks", status.alias("status"))


def pair_digest(rows: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    """sha256 of the identity."""
    return rows.withColumn("digest", F.sha2(F.concat_ws("|", F.lit(prefix), *columns), 256))


def component_join(parts: dict[str, DataFrame], on: str) -> DataFrame:
    """Components side by side by id with their columns prefixed, and which of them lack it."""
    out = None
    for name, df in parts.items():
        renamed = df.select(on, F.lit(True).alias(f"_has_{name}"), *[F.col(c).alias(f"{name}__{c}") for c in df.columns if c != on])
        out = renamed if out is None else out.join(renamed, on, "full_outer")
    missing = F.concat_ws(",", *[F.when(F.col(f"_has_{n}").isNull(), n) for n in parts])
    return out.withColumn("missing", missing).drop(*[f"_has_{n}" for n in parts])


def without_references(rows: DataFrame, references: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Rows that are no enrolled reference, and references not found among the rows."""
    return rows.join(references.select(on), on, "left_anti"), references.join(rows.select(on), on, "left_anti")


def nearest(events: DataFrame, samples: DataFrame, by: list[str]) -> DataFrame:
    """For each sample the neighbouring events before and after it, by one sort instead of a range join.

    events(by, t, v), samples(by, t, sample_id). Gives the value interpolated at the sample's time (0 outside the
    events' range) and the distance to the nearest event.
    """
    both = events.select(*by, "t", "v", F.lit(None).cast("long").alias("sample_id"), F.lit(0).alias("kind")).unionByName(
        samples.select(*by, "t", F.lit(None).cast("double").alias("v"), "sample_id", F.lit(1).alias("kind"))
    )
    pair = F.when(F.col("kind") == 0, F.struct("t", "v"))
    back = Window.partitionBy(*by).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy("t", F.desc("kind")).rowsBetween(0, Window.unboundedFollowing)
    rows = both.withColumn("a", F.last(pair, ignorenulls=True).over(back)).withColumn("b", F.first(pair, ignorenulls=True).over(ahead)).filter("kind = 1")
    span = F.col("b.t") - F.col("a.t")
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).when(span == 0, F.col("a.v")).otherwise(
        F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("t") - F.col("a.t")) / span
    )
    distance = F.least(F.col("t") - F.col("a.t"), F.col("b.t") - F.col("t"))
    return rows.select(*by, "sample_id", "t", value.alias("v"), distance.alias("distance"))


def spread_pivots(train: DataFrame, count: int, sample: int = 2000) -> list[list[float]]:
    """Vectors of train far from each other: of those of least hash, at most `sample`, in turn the farthest from all taken before."""
    import numpy as np

    rows = np.array([r["x"] for r in train.select("x").orderBy(F.xxhash64("x"), "x").limit(sample).collect()], float)
    if not rows.size:
        return []
    taken, far = [0], np.linalg.norm(rows - rows[0], axis=1)
    while len(taken) < count and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(rows - rows[taken[-1]], axis=1))
    return rows[taken].tolist()


def pivot_distances(rows: DataFrame, pivots: list[list[float]]) -> DataFrame:
    """rows(..., x array<double>) with `away array<double>`, the distances to the pivots."""
    import numpy as np
    import pyarrow as pa

    centres = np.array(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                away = np.sqrt(np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1))
                column = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(centres)), pa.array(away.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "away"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("away", T.ArrayType(T.DoubleType()))]))


#: Training vectors and queries that meet in a task, and queries that it takes at a time.
TRAIN_BLOCK, QUERY_BLOCK, AT_ONCE = 8192, 4096, 256


def meet(asked: DataFrame, placed: DataFrame, parts: int) -> DataFrame:
    """query_id, d, c: of asked(query_id, q, away, bound, mine, block) the least exact distance to the vectors of placed(x, low, high, cell,
    far, ring, block) and their number. A block of queries meets a block of vectors in one task.

    With a ring in `mine` (cell * 1e6 + ring) only its vectors count, else those whose distance to their pivot differs from the query's
    by at most the bound. A matrix product finds all distances but for rounding; those that may be least are taken again from differences.
    """
    import numpy as np
    import pyarrow as pa

    flat = lambda column: np.asarray(column.combine_chunks().flatten(), float).reshape(len(column), -1)

    def one(queries: pa.Table, train: pa.Table) -> pa.Table:
        ids, counts, least = queries["query_id"].to_numpy(), np.zeros(queries.num_rows, np.int64), np.full(queries.num_rows, np.inf)
        if train.num_rows and queries.num_rows:
            q, away, x = flat(queries["q"]), flat(queries["away"]), flat(train["x"])
            low, high, cell, ring, far = (train[c].to_numpy() for c in ("low", "high", "cell", "ring", "far"))
            bound, mine = (queries[c].to_numpy() for c in ("bound", "mine"))
            square, place = (x * x).sum(axis=1), cell.astype(np.int64) * 1_000_000 + ring
            for i in range(0, len(q), AT_ONCE):
                at = slice(i, i + AT_ONCE)
                part = q[at]
                fits = np.where(mine[at, None] >= 0, place[None] == mine[at, None], np.abs(far[None] - away[at][:, cell]) <= bound[at, None])
                fits &= (low[None] != ids[at, None]) | (high[None] != ids[at, None])
                own = (part * part).sum(axis=1)
                near = np.where(fits, own[:, None] + square[None] - 2 * part @ x.T, np.inf)
                slack = 1e-9 * (own + square.max()) + 1e-300
                rows, columns = np.nonzero(fits & (near <= near.min(axis=1)[:, None] + slack[:, None]))
                for k in range(0, len(rows), 100_000):
                    r, c = rows[k : k + 100_000], columns[k : k + 100_000]
                    np.minimum.at(least, i + r, np.sqrt(((part[r] - x[c]) ** 2).sum(axis=1)))
                counts[at] = fits.sum(axis=1)
        met = counts > 0
        return pa.table({"query_id": ids[met], "d": least[met], "c": counts[met]})

    left = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    right = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    each = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(one, "query_id long, d double, c long")
    return each.groupBy("query_id").agg(F.min("d").alias("d"), F.sum("c").alias("c"))


def least_distance(queries: DataFrame, train: DataFrame, pivots: int = 64, rings: int = 32) -> DataFrame:
    """`query_id, distance, compared`: the least root-mean-square distance of each query vector to the training vectors of
    other ids, and how many distinct ones it was compared with. queries, train(vec_id, x array<double>, all of one length).

    Training vectors lie in the cell of their nearest pivot, in a ring by their distance to it. A query first meets its own ring;
    the least distance found there bounds the rest: by the triangle inequality a vector nearer than the bound lies in
    rings whose distance to their pivot differs from the query's by no more. Neighbouring rings form blocks of about TRAIN_BLOCK
    vectors, a larger ring several, and a query goes to the blocks of its rings. Equal training vectors are compared once. How much
    that saves depends on the vectors: where all are about equally far apart, most rings are within the bound and all pairs
    are compared, as matrix products of blocks.
    """
    spark = queries.sparkSession
    same = train.groupBy("x").agg(F.min("vec_id").alias("low"), F.max("vec_id").alias("high"))
    centres = spread_pivots(train, pivots)
    if not centres:
        return queries.select(F.col("vec_id").alias("query_id"), F.lit(None).cast("double").alias("distance"), F.lit(0).cast("long").alias("compared")).limit(0)
    nearest = F.array_position("away", F.array_min("away")).cast("int") - 1
    placed = pivot_distances(same, centres).withColumn("cell", nearest).withColumn("far", F.array_min("away")).drop("away")
    placed = written(placed, "placed")
    reach = {r["cell"]: r["r"] for r in placed.groupBy("cell").agg(F.max("far").alias("r")).collect()}  # a row a pivot
    width = F.array(*[F.lit(max(reach.get(k, 0.0), 1e-12) / rings) for k in range(len(centres))])
    top = F.array(*[F.lit(reach.get(k, -1.0)) for k in range(len(centres))])
    ring = lambda d, k: F.floor(d / F.get(width, k)).cast("int")
    placed = placed.withColumn("ring", ring(F.col("far"), F.col("cell")))
    blocks, base, filled = [], 0, 0
    for r in placed.groupBy("cell", "ring").agg(F.count("*").alias("n")).orderBy("cell", "ring").collect():  # at most pivots * (rings + 1)
        if filled and filled + r["n"] > TRAIN_BLOCK:
            base, filled = base + 1, 0
        split = -(-r["n"] // TRAIN_BLOCK)
        blocks.append((r["cell"], r["ring"], base, split))
        base, filled = (base + split, 0) if split > 1 else (base, filled + r["n"])
    where = F.broadcast(spark.createDataFrame(blocks, "cell int, ring int, base int, split int"))
    block = (F.col("base") + F.pmod(F.xxhash64("x"), F.col("split"))).alias("block")
    placed = placed.join(where, ["cell", "ring"]).select("x", "low", "high", "cell", "far", "ring", block)
    asked = written(pivot_distances(queries.select(F.col("vec_id").alias("query_id"), "x"), centres).withColumnRenamed("x", "q"), "asked")
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    theirs = F.explode(F.sequence(F.col("base").cast("long"), (F.col("base") + F.col("split") - 1).cast("long"))).alias("block")

    own = asked.withColumn("cell", F.array_position("away", F.array_min("away")).cast("int") - 1).withColumn("ring", ring(F.array_min("away"), F.col("cell")))
    own = own.join(where, ["cell", "ring"]).select("query_id", "q", "away", F.lit(0.0).alias("bound"), (F.col("cell").cast("long") * 1_000_000 + F.col("ring")).alias("mine"), theirs)
    first = written(meet(own, placed, parts), "first")
    # Without one in its ring a query has its second pivot's distance as bound: it may be the first pivot itself.
    spare = F.get(F.array_sort("away"), F.lit(min(1, len(centres) - 1))) if len(centres) > 1 else F.lit(float("inf"))
    bound = (F.coalesce("d", spare) * (1 + 1e-9) + 1e-12).alias("bound")
    rest = written(asked.join(first, "query_id", "left").select("query_id", "q", "away", bound, F.lit(-1).cast("long").alias("mine")), "rest")
    cells = F.transform("away", lambda d, k: F.struct(k.alias("cell"), F.greatest(d - F.col("bound"), F.lit(0.0)).alias("lo"), F.least(d + F.col("bound"), F.get(top, k)).alias("hi")))
    met = rest.select("query_id", F.explode(F.filter(cells, lambda c: c["lo"] <= c["hi"])).alias("c")).select("query_id", "c.*")
    met = met.select("query_id", "cell", F.explode(F.sequence(ring(F.col("lo"), F.col("cell")), ring(F.col("hi"), F.col("cell")))).alias("ring"))
    met = met.join(where, ["cell", "ring"]).select("query_id", theirs).distinct()
    best = meet(rest.join(met, "query_id"), placed, parts).withColumnRenamed("c", "n").join(first.select("query_id", "c"), "query_id", "left")
    return best.select("query_id", (F.col("d") / F.lit(float(len(centres[0])) ** 0.5)).alias("distance"), (F.col("n") + F.coalesce("c", F.lit(0))).alias("compared"))


def two_sources(keys: DataFrame, raw: DataFrame, fallback: DataFrame, event: list[str], partial: bool = False) -> DataFrame:
    """The contact of each key of a typing event from raw touch first and, where that is absent or invalid, from one-finger
    contacts; an event with a key left over is rejected, unless `partial` allows it, with its reasons counted.

    keys(*event, key_id), raw and fallback(key_id, contact_id, reason), at most one row a key (as `assign` gives), reason null if
    valid. Returns one row an event: n_keys, n_raw, n_fallback, status and reason (`name=count` in order of names). Reasons are
    counted before an event's are listed, so that a list has one entry for each kind.
    """
    side = lambda df, name: df.filter("contact_id is not null").select("key_id", F.lit(True).alias(f"{name}_found"), F.col("reason").alias(f"{name}_reason"))
    j = keys.join(side(raw, "raw"), "key_id", "left").join(side(fallback, "one"), "key_id", "left")
    raw_fits = F.col("raw_found").isNotNull() & F.col("raw_reason").isNull()
    one_fits = ~raw_fits & F.col("one_found").isNotNull() & F.col("one_reason").isNull()
    why = F.coalesce("raw_reason", "one_reason", F.lit("key_has_no_matching_raw_or_one_finger_contact"))
    judged = j.select(*event, raw_fits.alias("by_raw"), one_fits.alias("by_one"), F.when(~raw_fits & ~one_fits, why).alias("why"))
    kinds = judged.groupBy(*event, "why").agg(F.count("*").alias("c"), F.count(F.when(F.col("by_raw"), 1)).alias("r"), F.count(F.when(F.col("by_one"), 1)).alias("o"))
    named = F.collect_list(F.when(F.col("why").isNotNull(), F.struct("why", F.concat_ws("=", "why", F.col("c").cast("string")).alias("s"))))
    whole = kinds.groupBy(*event).agg(F.sum("c").alias("n_keys"), F.sum("r").alias("n_raw"), F.sum("o").alias("n_fallback"), F.sort_array(named).alias("named"))
    matched = F.col("n_raw") + F.col("n_fallback")
    listed = F.concat(F.lit("incomplete_key_touch_alignment:"), F.array_join(F.col("named.s"), ";"))
    reason = F.when(~F.lit(partial) & (matched < F.col("n_keys")), listed).when(matched == 0, "typing_event_has_zero_aligned_keys")
    return whole.select(*event, "n_keys", "n_raw", "n_fallback", F.when(reason.isNull(), "accepted").otherwise("rejected").alias("status"), reason.alias("reason"))
