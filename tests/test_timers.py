"""Timers in streams: rows settle, sessions end, and windows of raw rows are read at each tick; also after a restart."""

import datetime as dt
import random

import pandas as pd
import pytest

from tidewater.sources.shared import fresh_path
from tidewater.streaming import timers

ZERO = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SPANS = "session bigint, text string, start double, end double, window_end double, ts timestamp"


def written(spark, folder, nth, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in-{nth}")


def ran(spark, make, schema, folder, checkpoint, out, files):
    """What a stream over the first files adds to out; each file is a batch."""
    for nth, rows in files:
        df = spark.createDataFrame(rows, schema).coalesce(1)
        df.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        q = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()


def at(s):
    return ZERO + dt.timedelta(seconds=s)


def span(session, text, second, begin=None):
    begin = second if begin is None else begin
    return (session, text, float(begin), second + 1.0, second + 2.0, at(second))


BATCHES = [
    [span(1, "今天天气很好", 0), span(2, "另一个会议室", 1)],
    [span(1, "今天天气很好我们出发。", 2, 0), span(1, "接着讨论预算。", 9)],
    [span(1, "最后总结几句。", 30)],
    [span(3, "第三间房。", 100)],
    [span(3, "还是这里呢。", 160), span(3, "全部结束。", 300)],
]


@pytest.fixture(scope="module")
def log(spark):
    folder, checkpoint, out = (fresh_path(spark, f"timers-{n}") for n in ("in", "cp", "out"))
    ran(spark, lambda s: timers.settling(s, "1 second", 5_000, 60_000), SPANS, folder, checkpoint, out, list(enumerate(BATCHES)))
    return spark.read.parquet(out).toPandas().sort_values(["session", "at", "idx", "event"])


def test_rows_settle_and_sessions_finish(log):
    seen = {(r.session, r.idx, r.event): r for r in log.itertuples()}
    zero = int(ZERO.timestamp() * 1000)
    # Session 2 said one thing, which settles five seconds later; when it is over nothing is left to tell.
    assert seen[2, 0, "change"].open and seen[2, 0, "settle"].at == zero + 6_000 and not seen[2, 0, "settle"].open and (2, 0, "finish") not in seen
    assert seen[1, 0, "settle"].text == "今天天气很好我们出发。" and seen[1, 0, "settle"].at == zero + 7_000
    assert [(r.idx, r.at - zero) for r in log[(log.session == 1) & (log.event == "settle")].itertuples()] == [(0, 7_000), (1, 14_000), (2, 35_000)]
    assert set(log[log.session == 1].event) == {"change", "settle"}
    # What the watermark hasn't passed is open still.
    assert list(log[(log.session == 3) & (log.text == "全部结束。")].event) == ["change"]


def test_a_restart_goes_on_as_if_there_had_been_none(spark, log):
    """The first files, an end, and the rest from the checkpoint give the same changelog as one run over all files."""
    folder, checkpoint, out = (fresh_path(spark, f"timers-{n}") for n in ("in", "cp", "out"))
    for nth, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, SPANS).coalesce(1).write.mode("append").parquet(folder)
        if nth in (1, 4):  # two runs: of two files, and of the three that came since
            make = timers.settling(spark.readStream.schema(SPANS).option("maxFilesPerTrigger", 1).parquet(folder), "1 second", 5_000, 60_000)
            make.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    again = spark.read.parquet(out).toPandas().sort_values(["session", "at", "idx", "event"])
    assert again.to_dict("list") == log.to_dict("list")


def test_a_session_that_is_over_is_flushed(spark):
    """Rows that wait longer than the session lasts are told as it finishes, once; and the state is gone, so it can begin anew."""
    folder, checkpoint, out = (fresh_path(spark, f"timers-{n}") for n in ("in", "cp", "out"))
    batches = [[span(1, "一个没说完的想法", 0)], [span(2, "另一间房里时间过去。", 100)], [span(1, "全新开始。", 200)], [span(2, "又来。", 400)]]
    ran(spark, lambda s: timers.settling(s, "1 second", 50_000, 20_000), SPANS, folder, checkpoint, out, list(enumerate(batches)))
    log = spark.read.parquet(out).where("session = 1").toPandas()
    done = log[log.event == "finish"].sort_values("at")
    assert list(done.text) == ["一个没说完的想法", "全新开始。"] and list(done.idx) == [0, 0] and not done.open.any()


def brute_ticks(rows, size, step):
    """Windows of all rows at each tick that has one in the step or size before it."""
    out = []
    for key in {k for k, _, _ in rows}:
        mine = sorted((int(t.timestamp() * 1000), v) for k, v, t in rows if k == key)
        ticks = {(t // step + n) * step for t, _ in mine for n in range(1, size // step + 1)}
        for tick in ticks:
            here = [(t, v) for t, v in mine if tick - size <= t < tick]
            if here:
                out.append((key, tick, len(here), 0, " ".join(v for _, v in here)))
    return sorted(out)


def test_ticks_are_batch_windows(spark):
    draw = random.Random(9)
    files, second = [], 0.0
    for _ in range(4):
        rows = []
        for _ in range(25):
            second += draw.random() * 3
            rows.append((draw.choice(["a", "b"]), f"w{draw.randrange(99)}", at(second)))
        files.append(rows)
    end = [("z", "end", at(second + 1000))]
    folder, checkpoint, out = (fresh_path(spark, f"ticks-{n}") for n in ("in", "cp", "out"))
    ran(spark, lambda s: timers.ticking(s, 12_000, 4_000, "1 second"), "key string, value string, ts timestamp", folder, checkpoint, out, list(enumerate([*files, end])))
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("key", "tick", "n", "lost", "text").collect())
    assert got == brute_ticks([r for f in files for r in f], 12_000, 4_000)


def test_ring_is_bounded_and_throttled(spark):
    rows = [("a", f"w{i}", at(i * 0.1)) for i in range(200)]
    folder, checkpoint, out = (fresh_path(spark, f"ticks-{n}") for n in ("in", "cp", "out"))
    ran(spark, lambda s: timers.ticking(s, 8_000, 2_000, "1 second", most=30, apart=6_000), "key string, value string, ts timestamp", folder, checkpoint, out, [(0, rows), (1, [("z", "", at(900))])])
    got = spark.read.parquet(out).orderBy("tick").toPandas()
    assert (got.n <= 30).all() and got.lost.iloc[0] == 170 and (got.tick.diff().dropna() >= 6_000).all()
    assert isinstance(got, pd.DataFrame) and len(got) >= 1
