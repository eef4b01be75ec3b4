"""Streams with watermarks: rows out of order, late rows, state that expires, and equality with the batch operators."""

import os
import random

import pytest
from pyspark.sql import functions as F

from chronoweave import streaming
from chronoweave.operators import intervals, probe

SECOND = 1_000_000


def run(spark, tmp_path, batches, schema, make, name):
    """What the stream tells of these batches, one file each, and the rows of state after each batch."""
    (tmp_path / "in").mkdir(parents=True)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/{i:03}")
        for f in (tmp_path / f"{i:03}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{i:03}.parquet")
            stamp = 1_000_000_000 + 10 * i  # the source reads files in order of their times
            os.utime(tmp_path / "in" / f"{i:03}.parquet", (stamp, stamp))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in q.recentProgress if p["stateOperators"])
    return sorted(map(tuple, spark.table(name).collect())), state, dropped


def test_thinning_out_of_order_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted([(rng.randrange(0, 400) * SECOND // 4, f"k{rng.randrange(3)}") for _ in range(239)] + [(0, "k0")])
    moved = sorted(rows, key=lambda r: r[0] + rng.randrange(0, 10 * SECOND))  # out of order by less than 10 s
    batches = [[(k, t) for t, k in moved[i : i + 80]] for i in range(0, 240, 80)] + [[("end", 1000 * SECOND)]]
    told, _, dropped = run(spark, tmp_path, batches, "k string, t long", lambda s: streaming.thin(s, "k", 3 * SECOND, late="10 seconds"), "thin_moved")
    batch = intervals.thin_by_spacing(spark.createDataFrame([(k, t) for t, k in rows], "k string, t long"), ["k"], 3 * SECOND).collect()
    assert dropped == 0 and told == sorted(map(tuple, batch))


def test_late_rows_are_dropped_and_state_expires(spark, tmp_path):
    batches = [[("x", 0), ("x", 100 * SECOND)], [("x", 99 * SECOND)], [("x", 50 * SECOND), ("x", 95 * SECOND)], [("y", 500 * SECOND)], [("y", 900 * SECOND)]]
    told, state, dropped = run(spark, tmp_path, batches, "k string, t long", lambda s: streaming.thin(s, "k", 2 * SECOND, late="10 seconds", idle_us=60 * SECOND), "thin_late")
    # The watermark has passed 90 s when the third batch comes: of its rows, the one at 95 s alone is in time.
    assert dropped == 1 and ("x", 50 * SECOND) not in told
    assert told == [("x", 0), ("x", 95 * SECOND), ("x", 99 * SECOND), ("y", 500 * SECOND)]
    # At 890 s, 60 s after all that was told, both keys' last points are gone: only y's last row waits.
    assert max(state) > state[-1]


@pytest.mark.parametrize("late", ["20 seconds"])
def test_track_out_of_order_equals_batch(spark, tmp_path, late):
    rng = random.Random(8)
    box = lambda i: (i, *(x := (rng.uniform(0, 3), rng.uniform(0, 3))), x[0] + rng.choice((0, 2, 3)), x[1] + rng.choice((1, 2)))
    frames = [(f"k{k}", f * SECOND, [box(i) for i in range(rng.randint(1, 3))] if f % 7 else []) for k in range(2) for f in range(40)]
    moved = sorted(frames, key=lambda r: r[1] + rng.randrange(0, 15 * SECOND))
    schema = "k string, pts long, boxes array<struct<det_idx int, l double, t double, r double, b double>>"
    batches = [moved[i : i + 27] for i in range(0, 80, 27)] + [[("end", 1000 * SECOND, [])]]
    told, _, dropped = run(spark, tmp_path, batches, schema, lambda s: streaming.track(s, "k", late=late), "track_moved")
    flat = spark.createDataFrame(frames, schema).select("k", "pts", F.explode_outer("boxes").alias("x")).select("k", "pts", "x.*")
    batch = probe.track_subject(flat, ["k"]).collect()
    assert dropped == 0 and len(batch) > 40 and told == sorted(map(tuple, batch))


def test_a_track_ends_where_no_frame_comes(spark, tmp_path):
    schema = "k string, pts long, boxes array<struct<det_idx int, l double, t double, r double, b double>>"
    small, large = (0, 0.0, 0.0, 1.0, 1.0), (1, 5.0, 5.0, 9.0, 9.0)
    batches = [[("x", 0, [small])], [("y", 300 * SECOND, [])], [("x", 400 * SECOND, [small, large])], [("y", 900 * SECOND, [])]]
    kept, _, _ = run(spark, tmp_path / "a", [*batches], schema, lambda s: streaming.track(s, "k", late="1 second", idle_us=3600 * SECOND), "track_kept")
    ended, _, _ = run(spark, tmp_path / "b", [*batches], schema, lambda s: streaming.track(s, "k", late="1 second", idle_us=60 * SECOND), "track_ended")
    assert kept[-1][:3] == ("x", 400 * SECOND, 0) and ended[-1][:3] == ("x", 400 * SECOND, 1)
