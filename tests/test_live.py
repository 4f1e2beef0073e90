"""A live source over growing recordings: it stops and resumes within a file, and a broken frame stops nothing."""

import json
import struct

from tidemark.sources import live, recordings
from tidemark.streaming import sessions


def frame(n):
    body = json.dumps({"id": n, "kind": "é" * (n % 3)}).encode()
    return struct.pack("<I", len(body)) + body


def run(spark, folder, at, options):
    """Reads all that is there, from where the last run stopped; batches go to tables of events and of bad events."""
    rows = live.decoded(live.live(spark, str(folder / "in"), **options), "id long, kind string")
    names = {"events": live.events, "bad": live.bad_events}
    q = rows.writeStream.foreachBatch(lambda b, k: sessions.written_once(b, k, str(folder / "out"), names)).option("checkpointLocation", str(folder / at)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_a_stream_stops_and_resumes_within_a_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    head = recordings.encode([], 7, False)
    whole = [frame(n) for n in range(12)]
    broken = struct.pack("<I", 3) + b"{x}"
    one, two = tmp_path / "in/one.rec", tmp_path / "in/two.rec"
    one.write_bytes(head + b"".join(whole[:3]) + whole[3][:6])  # the fourth frame is still being written
    two.write_bytes(head[:5])
    for options in ({}, {"frames_a_batch": "2"}):
        run(spark, tmp_path, "check", options)
        with one.open("ab") as f:
            f.write((whole[3][6:] + broken + b"".join(whole[4:8])) if not options else b"".join(whole[8:10]))
        two.write_bytes(head + whole[10] if not options else head + whole[10] + whole[11] + struct.pack("<I", 1 << 30) + b"lost")
        (tmp_path / "in/none.rec").write_bytes(b"something else entirely")
    run(spark, tmp_path, "check", {"frames_a_batch": "2"})
    run(spark, tmp_path, "check", {})  # nothing new
    got = sessions.whole_batches(spark, str(tmp_path / "out"), "events").collect()
    assert sorted((r.path.rpartition("/")[2], r.seq, r.id) for r in got) == sorted([("one.rec", n if n < 4 else n + 1, n) for n in range(10)] + [("two.rec", 0, 10), ("two.rec", 1, 11)])
    assert all(r.kind == "é" * (r.id % 3) for r in got)
    bad = sessions.whole_batches(spark, str(tmp_path / "out"), "bad").collect()
    assert sorted((r.path.rpartition("/")[2], r.seq, r.fault) for r in bad) == [("none.rec", 0, "not a recording of version 1"), ("one.rec", 4, "frame cannot be decoded"), ("two.rec", 2, "frame of 1073741824 bytes, more than 4194304")]
    assert [bytes(r.frame) for r in bad if r.path.endswith("/one.rec")] == [b"{x}"]
