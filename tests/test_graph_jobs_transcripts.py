"""Job states from tables and streams, and sentences of transcripts."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

from lexmill.operators import jobs, transcripts
from lexmill.streaming import jobs as stream

UPDATES = [(1, "running", 10.0, 0, 0), (1, "done", 100.0, 5, 3), (1, None, 60.0, 6, 4), (2, "running", 20.0, 1, 1), (2, "failed", None, 1, 2), (3, None, None, 2, 5)]


def updates(spark):
    return spark.createDataFrame([(a, b, c, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=d), e) for a, b, c, d, e in UPDATES], stream.UPDATES)


def test_job_states(spark):
    got = {r.job_id: (r.status, r.progress, r.n_updates) for r in jobs.job_states(updates(spark)).collect()}
    assert got == {1: ("done", 100.0, 3), 2: ("failed", 20.0, 2), 3: (None, None, 1)}
    assert jobs.job_states(updates(spark).limit(0)).count() == 0


def test_recent_jobs(spark):
    s = jobs.job_states(updates(spark))
    assert {r.job_id for r in jobs.recent_jobs(s, ["done"], 1).collect()} == {1, 3}


def test_job_stream(spark, tmp_path: Path):
    updates(spark).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(stream.UPDATES).parquet(f"{tmp_path}/in")
    q = stream.keep_states(source, f"{tmp_path}/out", f"{tmp_path}/at", available_now=True)
    q.awaitTermination(60)
    got = spark.read.parquet(f"{tmp_path}/out/v=0").select("job_id", "status", "progress")
    assert {tuple(r) for r in got.collect()} == {(1, "done", 100.0), (2, "failed", 20.0), (3, None, None)}
    more = spark.createDataFrame([(1, "failed", 10.0, dt.datetime(2024, 2, 1), 9)], stream.UPDATES)
    more.write.mode("append").parquet(f"{tmp_path}/in")
    stream.keep_states(source, f"{tmp_path}/out", f"{tmp_path}/at", available_now=True).awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out/v=1").count() == 1  # what changed alone
    got = stream.read_states(spark, f"{tmp_path}/out").select("job_id", "status", "progress", "n_updates")
    assert {tuple(r) for r in got.collect()} == {(1, "failed", 100.0, 4), (2, "failed", 20.0, 2), (3, None, None, 1)}


def sentences(spark, lines: list[str | None]):
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(lines)], "transcript_id string, n int, line string")
    return [(round(r.sec, 3), r.sentence) for r in transcripts.sentences(df).orderBy("place").collect()]


def test_reflow(spark):
    got = sentences(spark, ["---", "title", "[00:01.00] aa bb.", "Mr. cc", None, "[00:03.00] dd! ee", "", "[01:00:00] ff."])
    # the first line is "aa bb. Mr. cc": weights 2, 6, 6, 2 over 2 s
    assert got == [(1.0, "aa bb."), (2.0, "Mr. cc dd!"), (round(3 + 2.5 * 6 / 8, 3), "ee ff.")]


def test_aligned_lines_stay(spark):
    assert sentences(spark, ["[00:01.00] One two.", "[00:09.00] Three?", "[00:10.00] Four!"]) == [(1.0, "One two."), (9.0, "Three?"), (10.0, "Four!")]


def test_long_sentences_part_at_commas(spark):
    words = ["a,"] * 3 + ["b"] * 40 + ["c,"] + ["d"] * 50
    assert [s for _, s in sentences(spark, ["[00:00.00] " + " ".join(words)])] == [" ".join(words[:44]), " ".join(words[44:])]


def test_no_lines(spark):
    assert sentences(spark, ["no time", None]) == []


def test_subtitles(spark):
    from lexmill.sources import transcripts as files

    srt = "1\n00:01:02,500 --> 00:01:03,000\nHello there.\nSecond line\n\nbroken\n\n2\nno time\nx\n\n3\n01:00:00.000 --> x\nEnd"
    vtt = "WEBVTT\n\n00:01.000 --> 00:02.000\n<c>one two</c>\n\nid\n00:02.000 --> 00:03.000\none two\nthree\n\n01:00:03.500 --> 01:00:04.000\nthree\n four  five \n\n00:09.000 --> 00:10.000\n \n"
    df = spark.createDataFrame([("a", srt), ("n", None), ("e", "")], "file string, text string")
    assert [(r.file, r.sec, r.text) for r in files.parse_srt(df).orderBy("n").collect()] == [("a", 62.5, "Hello there. Second line"), ("a", 3600.0, "End")]
    df = spark.createDataFrame([("v", vtt), ("n", None), ("e", "")], "file string, text string")
    got = files.parse_vtt(df)
    assert [(r.sec, r.text) for r in got.orderBy("n").collect()] == [(1.0, "one two"), (2.0, "three"), (3603.5, "four five")]
    assert [r.line for r in files.stamped(got).orderBy("n").collect()] == ["[00:01.00] one two", "[00:02.00] three", "[01:00:03.50] four five"]
    assert files.parse_vtt(df.limit(0)).count() == files.parse_srt(df.limit(0)).count() == 0
    lines = "\n\n".join(f"00:0{i}.000 --> 00:0{i}.500\nl{i % 4}" for i in range(9))
    few = spark.createDataFrame([("v", lines)], "file string, text string")
    assert files.parse_vtt(few).count() == 4 and files.parse_vtt(few, recent=2).count() == 9


def test_logs(spark):
    from lexmill.sources import logs

    text = "=== TASK: t 1 ===\r\n=== MODEL: m ===\n--- SYSTEM PROMPT ---\nsys\n--- USER PROMPT ---\nuser\n--- CONSOLIDATED ITEM 1\nx\n--- RAW RESPONSE ---\n<think>{</think> so ```json\n{\"a\": 1}\n``` done\n=== END OF LOG ==="
    got = logs.parse_logs(spark.createDataFrame([("a", text), ("b", "=== TASK: x ==="), ("c", None)], "log_name string, text string")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.task, r.model, r.status, r.timestamp, r.failure_category, r.system_prompt, r.user_prompt, r.response_json) == ("t 1", "m", "SUCCESS", "", None, "sys", "user", '{"a": 1}')


def test_subrip_with_carriage_returns(spark):
    from lexmill.sources.transcripts import parse_srt

    text = "1\r\n00:00:01,000 --> 00:00:02,000\r\nHello\r\nSecond\r\n\r\n2\r\n00:00:03,500 --> 00:00:04,000\r\nBye\r\n"
    files = spark.createDataFrame([("a", text)], "file string, text string")
    assert [(r.sec, r.text) for r in parse_srt(files).orderBy("n").collect()] == [(1.0, "Hello Second"), (3.5, "Bye")]


def test_logs_keep_null_characters(spark):
    from lexmill.sources.logs import parse_logs

    log = "=== TASK: t ===\n=== MODEL: m ===\n--- USER PROMPT ---\na\x00b\n--- RAW RESPONSE ---\n{}\x00\n=== END OF LOG ==="
    r = parse_logs(spark.createDataFrame([("l", log)], "log_name string, text string")).first()
    assert (r.user_prompt, r.raw_response) == ("a\x00b", "{}\x00")
