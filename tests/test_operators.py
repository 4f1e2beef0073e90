"""Operators on small vectors whose results are plain to see."""

import hashlib
import hmac
import json
import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from tidemark.functions import privacy as priv
from tidemark.functions import text as T
from tidemark.operators import adapters, graph, ingest, monitor, search, sensors, vectors
from tidemark.operators import privacy as gate
from tidemark.operators import relational as rel
from tidemark.sources import recordings, spool
from tidemark.sources.storage import Tables
from tidemark.streaming import sessions

S = 1_000_000_000
EVENT = "seq long, t_ns long, toplevel_id long, kind string, app_id string, title string, pid long, active boolean"


def events(spark, rows):
    """rows: (second, kind, value) of one window."""
    out = []
    for seq, (t, kind, value) in enumerate(rows, 1):
        out.append((seq, int(t * S), 1, kind if kind in ("Opened", "TitleChanged", "Closed") else "StateChanged", "app" if kind == "Opened" else None, value if kind in ("Opened", "TitleChanged") else None, 7 if kind == "Opened" else None, {"on": True, "off": False}.get(kind)))
    return spark.createDataFrame(out, EVENT)


def spans(spark, rows):
    t = ingest.segments(ingest.attributed(events(spark, rows))).where("t_end_ns IS NOT NULL").orderBy("seq").collect()
    return [(r.t_start_ns / S, r.t_end_ns / S, r.title) for r in t]


def test_segments(spark):
    assert spans(spark, [(0, "Opened", "a"), (0, "on", None), (1, "TitleChanged", "b"), (2, "TitleChanged", "* b"), (7, "TitleChanged", "c"), (10, "off", None)]) == [(0, 1, "a"), (1, 7, "b"), (7, 10, "c")]
    assert spans(spark, [(0, "Opened", "a"), (0, "on", None), (6, "Closed", None), (7, "off", None), (8, "on", None)]) == [(0, 6, "a")]
    assert spans(spark, [(0, "Opened", "a"), (1, "on", None), (4, "on", None), (5, "off", None), (6, "off", None)]) == [(4, 5, "a")]
    assert spans(spark, [(0, "on", None), (1, "off", None), (2, "Opened", "a"), (3, "TitleChanged", "b"), (4, "off", None)]) == []


def test_gate_edges(spark):
    promoted = lambda rows: [r.promoted for r in ingest.gated(ingest.segments(ingest.attributed(events(spark, rows))), "app_id").orderBy("seq").collect()]
    assert promoted([(0, "Opened", "a"), (0, "on", None), (5, "off", None)]) == [False, False]
    assert promoted([(0, "Opened", "a"), (0, "on", None), (5.001, "off", None)]) == [False, True]
    assert promoted([(0, "Opened", "a"), (0, "on", None), (1, "on", None), (2, "on", None), (2.5, "off", None)]) == [False, False, True, True]


def test_observer_and_cooldown(spark):
    e = events(spark, [(0, "Opened", "a"), (0, "on", None), (9, "off", None)])
    assert ingest.attributed(e, ("app",)).count() == 0 and ingest.attributed(e, (), "ap").count() == 0
    rows = spark.createDataFrame([("x", t) for t in (0, 300, 600, 601, 1200, 1300)], "text string, t long")
    assert sorted(r.t for r in ingest.cooled(rows, "text", "t", 600).collect()) == [0, 601, 1300]


def test_bounded_state(spark):
    rows = [("k%02d" % i, i, i < 2) for i in range(10)]
    c = spark.createDataFrame(rows, "key string, last_ns long, promoted boolean")
    keep = lambda most, ttl: sorted(r.key for r in ingest.evicted(c, 10, most, ttl).collect())
    assert len(keep(10, 0)) == 10 and keep(8, 3) == ["k00", "k01", "k07", "k08", "k09"] and keep(4, 100) == ["k00", "k01", "k09"]


def test_process_roots(spark):
    t = spark.createDataFrame([(1, 10, [(10, 1, "sh"), (11, 10, "cc1")]), (2, 20, [(20, 1, "sh"), (11, 20, "ld")]), (3, 10, [(10, 1, "sh"), (12, 10, "as")])], "seq long, root_pid long, processes array<struct<pid:long,ppid:long,comm:string>>")
    got = {r.pid: r.root_pid for r in ingest.collapse(spark.createDataFrame([(10,), (11,), (12,), (99,)], "pid long"), ingest.pid_roots(t)).collect()}
    assert got == {10: 10, 11: 20, 12: 10, 99: 99}


def test_bands_and_paths(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(adapters.cpu_band(F.lit(x))) for x in (float("nan"), 9.9, 10.0, 40.0, 80.0)] == ["unknown", "idle", "light", "busy", "saturated"]
    assert [one(adapters.mem_band(F.lit(u), F.lit(t))) for u, t in ((0, 0), (4, 16), (8, 16), (15, 16))] == ["unknown", "low", "high", "pressure"]
    want = {"/r/.git/index": True, "/r/.git/COMMIT_EDITMSG": False, "/r/a.swp": True, "/r/target/x": True, "/r/src/x.rs": False, "/r/.#x": True, "/r/x~": True}
    assert {p: one(adapters.churn(F.lit(p))) for p in want} == want
    assert one(adapters.player(F.lit("org.mpris.MediaPlayer2.brave.instance6407"))) == "brave"


def test_snap_order(spark):
    focus = spark.createDataFrame([(1, "a", 0, 100), (2, "b", 150, 200), (3, "c", 90, 400)], "id long, app_id string, t_start_ns long, t_end_ns long")
    probes = spark.createDataFrame([(i, t) for i, t in enumerate((50, 95, 210, 1000, 405))], "probe_id long, t_ns long")
    got = {r.probe_id: r.app_id for r in rel.snapped(probes, focus, 20).collect()}
    assert got == {0: "a", 1: "a", 2: "c", 3: None, 4: "c"}


def test_merge(spark):
    e = spark.createDataFrame([(1, "d", "x", "k", 1, 100, 200, False), (2, "d", "x", "m", 2, 50, 900, True), (3, "d", "y", "k", 0, 1, 1, False)], "id long, domain string, label string, kind string, taint long, created_ns long, last_seen_ns long, permanent boolean")
    kept, renames = rel.merged_entities(e)
    assert {(r.id, r.kind, r.taint, r.created_ns, r.last_seen_ns, r.permanent) for r in kept.collect()} == {(1, "k", 3, 50, 900, True), (3, "k", 0, 1, 1, False)}
    edges = spark.createDataFrame([(1, 3, "c", 5.0, 1, True), (2, 3, "c", 9.0, 2, True), (1, 2, "c", 1.0, 3, True)], "src long, dst long, kind string, weight double, reinforced_ns long, hypothesis boolean")
    assert [(r.src, r.dst, r.weight) for r in rel.merged_edges(edges, renames).collect()] == [(1, 3, 5.0)]


def test_durations_and_intents(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(rel.duration_ns(F.lit(x))) for x in ("30s", "2h", "1w", "5", "x", "99999999999999d")] == [30 * S, 7200 * S, 604800 * S, None, None, None]
    i = one(T.intent(F.lit("What was on Before lunch after all?!")))
    assert (i.intent, i.before, i.anchor) == ("around", True, "lunch after all")
    assert one(T.intent(F.lit("where did I spend it"))).intent == "overview" and one(T.intent(F.lit("The latest x"))).intent == "latest"
    assert one(T.truncate_bytes(F.lit("aé😀b"), 4)) == "aé" and one(T.truncate_bytes(F.lit("aé😀b"), 7)) == "aé😀"


def test_fusion_ranks(spark):
    """Repeats use up dense ranks, not keyword ranks; taints of all copies unite."""
    schema = "q_id long, rank int, chunk_id string, text string, taint long, t_ns long, domain string"
    dense = spark.createDataFrame([(0, 1, "a", "one", 1, 1, "d", 0.1), (0, 2, "b", "one", 4, 1, "d", 0.2), (0, 3, "c", "two", 0, 1, "d", 0.3)], schema + ", distance double")
    words = spark.createDataFrame([(0, 1, "x", "three", 0, 1, "d"), (0, 2, "y", "three", 2, 1, "d"), (0, 3, "b", "one", 8, 1, "d")], schema)
    q = spark.createDataFrame([(0, "one three ones")], "q_id long, question string")
    got = {r.text: r for r in search.fused(dense, words, q, 9).collect()}
    assert got["one"].rrf == pytest.approx(1 / 61 + 1 / 62, abs=1e-8) and got["one"].taint == 13 and got["one"].keyword_score == 2
    assert got["two"].rrf == pytest.approx(1 / 63, abs=1e-8) and got["three"].distance == 2.0 and got["three"].taint == 2 and got["one"].rank == 1


def test_pseudonyms(spark):
    key, kind, value = b"secret", "title", "naïve"
    want = hmac.new(key, len(kind).to_bytes(8, "little") + kind.encode() + value.encode(), hashlib.sha256).hexdigest()[:16]
    r = spark.range(1).select(priv.placeholder(key, kind, F.lit(value)).alias("a"), priv.placeholder(key, kind, F.lit("")).alias("b"), priv.anonymous_path(key, F.lit("/x/y.tar.gz")).alias("c")).first()
    assert r.a == f"title-{want}" and r.b == "" and r.c.startswith("/anon/") and r.c.endswith(".gz")


def test_gate_and_pauses(spark):
    e = spark.createDataFrame([(1, 5, "a"), (2, 15, None), (3, 25, "bad"), (4, 35, None)], "seq long, t_ns long, app_id string")
    c = spark.createDataFrame([(1, 10, "pause", 0), (2, 20, "resume", 0), (3, 30, "pause", (1 << 63) - 5)], "seq long, t_ns long, action string, for_ns long")
    assert [r.seq for r in gate.allowed(e, spark.createDataFrame([("bad",)], "app_id string"), gate.pauses(c)).collect()] == [1]


def test_percentiles_and_grades(spark):
    h = spark.createDataFrame([("c", 10, 90), ("c", 20, 9), ("c", 1000, 1)], "component string, upper_ns long, count long")
    p = lambda x: monitor.percentile(h, ["component"], x).first().p_ns
    assert (p(0.5), p(0.99), p(1.0), p(0.0), p(1.5)) == (10, 20, 1000, 10, None)
    b = spark.createDataFrame([("c", 1, 100, 100, True), ("c", 2, 105, 110, True), ("c", 3, 106, 111, True), ("z", 1, 0, 0, True), ("z", 2, 9, 9, True)], "component string, seq long, rss long, p99_ns long, reachable boolean")
    assert [(r.seq, r.summary) for r in monitor.breach_summary(monitor.breaches(b)).collect()] == [(3, "rss_growth=6.0%;p99_drift=11.0%")]
    slots = spark.createDataFrame([(1, 2, "é".encode()[1:], False), (1, 1, b"a" + "é".encode()[:1], False), (1, 3, b"x", True), (1, 4, b"y", False), (2, 1, b"z", False)], "generation long, seq long, piece binary, eos boolean")
    assert monitor.reassembled(slots, None, spark.createDataFrame([(2,)], "generation long")).first().text == "aé"


def test_propagation(spark):
    e = spark.createDataFrame([(1, 100), (2, 110), (3, 120), (9, 10**6)], "id long, last_seen_ns long")
    pairs = graph.candidates(e, 10)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(1, 2), (2, 3)]
    none = spark.createDataFrame([], "src long, dst long, kind string, weight double")
    m = graph.normalised(e, graph.weighted(e, none, pairs))
    z = {r.id: r.z for r in graph.propagated(spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 0.0), (9, 0.0)], "id long, z0 double"), m).collect()}
    assert z[1] > z[2] > z[3] > z[9] == 0


def test_sensors(spark):
    p = spark.createDataFrame([(5, 1, "Firefox"), (6, 5, "firefox-bin"), (7, 6, "a-very-long-com"), (1, 7, "x")], "pid long, ppid long, comm string")
    apps = spark.createDataFrame([("org.mozilla.Firefox",), ("a-very-long-command",), ("org.",), ("fi",)], "app_id string")
    assert {r.app_id: r.pid for r in sensors.app_pids(apps, p).collect()} == {"org.mozilla.Firefox": 6, "a-very-long-command": 7}
    assert {(r.pid, r.depth) for r in sensors.subtree(p, p.where("pid = 5")).collect()} == {(5, 0), (6, 1), (7, 2), (1, 3)}


def test_recordings(spark, tmp_path):
    body = recordings.encode([b"one", b"", b"three"], 42, True)
    (tmp_path / "a.bin").write_bytes(body)
    rows = recordings.read(spark, str(tmp_path / "a.bin")).orderBy("seq").collect()
    assert [(r.seq, bytes(r.frame), r.created_ns, r.anonymised) for r in rows] == [(0, b"one", 42, True), (1, b"", 42, True), (2, b"three", 42, True)]
    rng = random.Random(1)
    for _ in range(50):
        parts = [rng.randbytes(rng.randrange(20)) for _ in range(rng.randrange(5))]
        assert list(recordings.frames(recordings.encode(parts, 1, False))) == parts
    for bad in (b"", b"XXXX" + body[4:], body[:-1], body[: recordings.HEADER.size + 2], body[: recordings.HEADER.size] + b"\xff\xff\xff\xff"):
        with pytest.raises(recordings.RecordingError):
            list(recordings.frames(bad))
    with pytest.raises(recordings.RecordingError):
        recordings.encode([b"x" * (recordings.MOST + 1)], 1, False)


def test_spool(spark, tmp_path):
    docs = {"a": {"doc_id": "a", "text": "hello", "url": "u"}, "b": {"doc_id": "b", "text": "  "}, "c": {"doc_id": "c", "text": "x", "content_type": "image/png"}, "d": {"doc_id": "d", "text": "y" * ((1 << 20) + 1)}}
    for k, v in docs.items():
        (tmp_path / f"{k}.json").write_text(json.dumps(v))
    (tmp_path / "e.json").write_text("{broken")
    (tmp_path / "f.txt").write_text("{}")
    got = {r.path.rsplit("/", 1)[-1]: r.reason for r in spool.read(spark, str(tmp_path)).collect()}
    assert got == {"a.json": None, "b.json": "no text", "c.json": "not text", "d.json": "too long", "e.json": "not JSON"}
    for _ in range(2):  # accepted files go once they are in the table, refused ones stay, and nothing is taken twice
        q = spool.ingest(spark, str(tmp_path), f"{tmp_path}-out", f"{tmp_path}-checkpoint", once=True)
        assert q.awaitTermination(90) is not False
        assert [r.doc_id for r in spark.read.parquet(f"{tmp_path}-out").collect()] == ["a"]
        assert sorted(x.name for x in tmp_path.glob("*.json")) == ["b.json", "c.json", "d.json", "e.json"]


def test_recordings_are_written_and_read(spark, tmp_path):
    at = str(tmp_path / "rec")
    rows = spark.createDataFrame([(i, bytes([i % 7]) * (i % 50)) for i in range(900)], "seq long, frame binary").repartitionByRange(3, "seq")
    recordings.write(rows, at, 99, True)
    got = recordings.read(spark, at).orderBy("path", "seq").collect()
    assert [bytes(r.frame) for r in got] == [bytes([i % 7]) * (i % 50) for i in range(900)] and {(r.created_ns, r.anonymised) for r in got} == {(99, True)}
    with pytest.raises(recordings.RecordingError):
        recordings.write(rows, at, 99, True)


def test_snap_is_brute_force(spark):
    rng = random.Random(5)
    focus = [(i, "a%d" % i, s, s + rng.choice([0, 1, 5, 30, 400])) for i, s in ((i, rng.randrange(-50, 1000)) for i in range(120))]
    probes = [(i, rng.randrange(-200, 1500)) for i in range(400)]
    f = spark.createDataFrame(focus, "id long, app_id string, t_start_ns long, t_end_ns long")
    got = {r.probe_id: r.id for r in rel.snapped(spark.createDataFrame(probes, "probe_id long, t_ns long"), f, 20).collect()}
    for p, t in probes:
        near = [((not s <= t <= e), min(abs(s - t), abs(e - t)), s, i) for i, _, s, e in focus if e >= t - 20 and s <= t + 20]
        assert got[p] == (min(near)[3] if near else None), (p, t)
    assert rel.snapped(spark.createDataFrame(probes, "probe_id long, t_ns long"), f.limit(0), 20).where("id IS NOT NULL").count() == 0


def test_cooldown_is_a_fold(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(3000)) for _ in range(2000)] + [("c", None)]
    want = set()
    for text in ("a", "b", None):
        last = None
        for t in sorted(t for x, t in rows if x == text):
            if last is None or t - last > 50:
                want.add((text, t))
                last = t
    assert {tuple(r) for r in ingest.cooled(spark.createDataFrame(rows, "text string, t long"), "text", "t", 50).collect()} == want


def test_deep_trees_and_prefixes(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 41)], "pid long, ppid long")
    assert sensors.subtree(chain, chain.where("pid = 1")).agg(F.max("depth")).first()[0] == 39
    b = spark.createDataFrame([(1, ["a", "b"]), (5, ["a", "c"]), (9, ["a", "c", "d"]), (10, [])], "seq long, tokens array<string>")
    for run in (1, 4, 1 << 16):
        assert {r.seq: r.shared for r in monitor.common_prefix(b, run).collect()} == {1: 0, 5: 1, 9: 2, 10: 0}


def test_full_buffers(spark):
    o = spark.createDataFrame([(1, s) for s in range(10)] + [(2, 3)], "batch long, seq long")
    drops = lambda newest: {r.batch: (r.kept, r.dropped, r.edge) for r in monitor.drained(o, 4, newest).collect()}
    assert drops(True) == {1: (4, 6, 6), 2: (1, 0, 3)} and drops(False) == {1: (4, 6, 3), 2: (1, 0, 3)}


def test_tables(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "root"))
    for n in (3, 5, 7):
        t.write("numbers", spark.range(n))
    assert t.read("numbers").count() == 7 and t.versions("numbers") == ["v000002", "v000003"]
    t.compact("numbers", 1)
    assert t.fragments("numbers").count() == 1
    for k in range(4):
        kept = t.backup(str(tmp_path / "backup"), f"2024010{k}", keep=2)
    assert kept == ["20240102", "20240103"] and spark.read.parquet(str(tmp_path / "backup/20240103/numbers")).count() == 7
    log = []
    steps = {1: lambda _: log.append(1), 2: lambda x: x.write("extra", spark.range(1))}
    assert t.migrate(steps) == [1, 2] and t.migrate(steps | {3: lambda _: log.append(3)}) == [3] and log == [1, 3]
    with pytest.raises(LookupError):
        t.read("nothing")


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    from tidemark.sources.tables import telemetry

    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # timeouts alone would keep it running
    rows = telemetry(spark, sf_dir).select("seq", "t_ns", "toplevel_id", "kind", "app_id", "title", "pid", "active")
    top = rows.agg(F.max("seq")).first()[0]
    cuts = [-1, top // 3, 2 * top // 3, top]
    for a, b in pairwise(cuts):
        rows.where((F.col("seq") > a) & (F.col("seq") <= b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sessions.segments(stream, ("app-9",)).writeStream.format("memory").queryName("touches").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    want = ingest.segments(ingest.attributed(rows, ("app-9",)))
    assert sorted(map(str, spark.table("touches").collect())) == sorted(map(str, want.select(*spark.table("touches").columns).collect()))


def test_batches_are_written_once(spark, tmp_path):
    for _ in range(2):
        sessions.written_once(spark.range(5), 7, str(tmp_path), {"all": lambda b: b, "even": lambda b: b.where("id % 2 = 0")})
    spark.range(3).write.parquet(str(tmp_path / "all/batch=8"))  # a batch that was not finished
    assert sessions.whole_batches(spark, str(tmp_path), "all").count() == 5 and spark.read.parquet(str(tmp_path / "even")).count() == 3


def test_embeddings(spark):
    e = vectors.embedded(spark.createDataFrame([(1, "a b a"), (2, "A, b a!"), (3, "")], "id long, text string"), 16).orderBy("id").collect()
    assert e[0].vector == e[1].vector and sum(x * x for x in e[0].vector) == pytest.approx(1, abs=1e-5) and set(e[2].vector) == {0.0}
