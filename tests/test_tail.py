"""Growing logs: appended, half-written, rotated, truncated and replaced files; restarts (S8, ST4)."""
import os
import random

import pytest

from netlens.sources.tail import TailReader, TailStreamReader, line_files, read_lines


class Log:
    """A stream reader, driven by hand as the engine drives it."""

    def __init__(self, path, split=64 << 20):
        self.options = {"path": path, "splitBytes": str(split)}
        self.reader, self.at = TailStreamReader(self.options), None
        self.at = self.reader.initialOffset()

    def batch(self):
        end = self.reader.latestOffset()
        got = self.lines(self.at, end)
        self.last, self.at = (self.at, end), end
        return got

    def lines(self, start, end):
        return [r[0] for p in self.reader.partitions(start, end) for r in self.reader.read(p)]

    def restart(self):
        self.reader = TailStreamReader(self.options)


def write(path, text, mode="a"):
    with open(path, mode, encoding="utf-8") as f:
        f.write(text)


@pytest.fixture()
def log(tmp_path):
    return Log(f"{tmp_path}/eve.json*"), f"{tmp_path}/eve.json"


def test_appended_lines_are_read_once(log):
    log, path = log
    assert log.batch() == []
    write(path, "a\nb\n")
    assert log.batch() == ["a", "b"]
    assert log.batch() == []
    write(path, "c\n\nd\n")
    assert log.batch() == ["c", "", "d"]


def test_half_written_line_waits(log):
    log, path = log
    write(path, 'a\n{"x": "é')
    assert log.batch() == ["a"]
    write(path, '日"}\r')
    assert log.batch() == []
    write(path, "\n")
    assert log.batch() == ['{"x": "é日"}']


def test_rotation_by_renaming_loses_and_repeats_nothing(log):
    log, path = log
    write(path, "a\nb\n")
    assert log.batch() == ["a", "b"]
    write(path, "c\n")                                # not yet read when the file is renamed
    os.rename(path, path + ".1")
    write(path, "d\n")
    assert sorted(log.batch()) == ["c", "d"]
    os.rename(path + ".1", path + ".2")
    os.rename(path, path + ".1")
    write(path, "e\nf\ng\n")
    assert sorted(log.batch()) == ["e", "f", "g"]
    os.remove(path + ".2")
    write(path + ".1", "h\n")
    assert log.batch() == ["h"]


def test_truncated_and_replaced_files_start_anew(log):
    log, path = log
    write(path, "a\nb\nc\n")
    assert log.batch() == ["a", "b", "c"]
    write(path, "x\n", "w")                           # shorter
    assert log.batch() == ["x"]
    write(path, "y\nz\nw\n", "w")                     # longer than what was read of the old one
    assert log.batch() == ["y", "z", "w"]


def test_replay_after_restart_reads_the_same(log):
    log, path = log
    write(path, "a\n")
    log.batch()
    write(path, "b\nc\n")
    first = log.batch()
    os.rename(path, path + ".1")                      # between the run and its replay
    write(path, "d\n")
    log.restart()
    assert log.lines(*log.last) == first == ["b", "c"]
    assert log.batch() == ["d"]


def test_file_that_has_gone_raises(log):
    log, path = log
    write(path, "a\n")
    end = log.reader.latestOffset()
    os.remove(path)
    with pytest.raises(FileNotFoundError):
        log.reader.partitions(log.at, end)


def test_equal_files_are_both_read(tmp_path):
    for name in ("a", "b"):
        write(f"{tmp_path}/{name}.json", "same\n")
    assert Log(str(tmp_path)).batch() == ["same", "same"]


@pytest.mark.parametrize("split", [1, 2, 3, 7, 64, 1 << 20])
def test_ranges_cover_every_line_once(tmp_path, split):
    rng = random.Random(split)
    lines = ["x" * rng.choice([0, 0, 1, 2, 5, 30]) for _ in range(60)] + ["é" * 40_000] * (split > 60)
    path = f"{tmp_path}/f.json"
    write(path, "".join(f"{x}\n" for x in lines) + "tail")
    reader = TailReader({"path": path, "splitBytes": str(split)})
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == lines
    start = len(lines[0]) + len(lines[1]) + 2
    size = os.path.getsize(path) - 4
    got = [x for a in range(start, size, split) for x in read_lines(path, a, min(size, a + split), start)]
    assert got == lines[2:]


def test_patterns(tmp_path):
    for name in ("a/x.json", "a/_SUCCESS", "a/.x.json.crc", "b/y.json", "c.json", "b/deep/z.json"):
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        write(f"{tmp_path}/{name}", "1\n")
    names = lambda p: [f[len(str(tmp_path)) + 1:] for f, _, _ in line_files(f"{tmp_path}/{p}")]
    assert names("*") == ["a/x.json", "b/y.json", "c.json"] and names("a") == ["a/x.json"] and names("[b]") == ["b/y.json"]
    assert names("a/x.json") == ["a/x.json"] and names("none*") == [] and names("none") == []


def test_stream_over_a_growing_log(spark, tmp_path):
    from netlens.streaming.streams import stream_event_alerts, write_alert_stream
    event = '{"event_type": "alert", "timestamp": "2026-01-01T00:00:0%d.000000+0000", "src_ip": "10.0.0.1", "alert": {"signature": "s%d", "severity": 1}}'
    path = f"{tmp_path}/logs/eve.json"
    os.makedirs(f"{tmp_path}/logs")

    def run():
        write_alert_stream(stream_event_alerts(spark, f"{tmp_path}/logs"), f"{tmp_path}/out", f"{tmp_path}/ck",
                           trigger={"availableNow": True}).awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out").count()

    write(path, event % (1, 1) + "\n" + event % (2, 2) + "\n")
    assert run() == 2
    write(path, event % (3, 3) + "\nnot json\n" + (event % (4, 4))[:30])
    assert run() == 3
    write(path, (event % (4, 4))[30:] + "\n")
    os.rename(path, path + ".1")
    write(path, event % (5, 5) + "\n")
    assert run() == 5 and run() == 5
