"""Mixing, PII and chat against plain-Python versions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, mixing, personal

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def luhn(d):
    return sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    text, out = text or "", []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


TRICKY = [
    None, "", "a@b.com_x@c.de, .@a.b.c", "x@y", "a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.4 999.1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112",
    "é😀 4111111111111111 +1 (202) 555-0136 +12 +1234567 +1 23456789012345678", "1 2 3 4 5 6 7 8 " * 500, "+1((((" * 300, "a" * 20000 + "@", "9" * 5000, "call +44 20 7946 0958. GB82 WEST 1234 5698 7654 32 iban",
    "DE89370400440532013000 is my account; ssn 123-45-6789 here", "\x00\x01<|x|> a@b.co\nb@c.de",
]


def test_spans_match_plain_regexes(spark):
    rng = random.Random(5)
    alphabet = ["a", "b", ".", "@", "1", "23", "4111111111111111", " ", "-", "+1", "(", ")", "_", "é", "256", "0", "\n", "%"]
    texts = TRICKY + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).withColumn("spans", F.lit(1)).withColumn("kind", F.lit("k"))
    got = {r.doc_id: r for r in personal.report(docs).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i].base_sha256 == sha(",".join("%s:%d:%d" % x for x in want)), (t, want, got[i])
        assert [got[i][f"n_{k}"] for k in personal.BASE] == [sum(x[0] == k for x in want) for k in personal.BASE]
        assert all("%s:%d:%d" % x in got[i].spans for x in want)
    assert "iban:" in got[13].spans and "iban:" in got[14].spans and "ssn:" in got[14].spans


def test_emails_at_a_hyphen_are_found_and_redacted(spark):
    texts = ["bob@-x.com", "a gain@-0.5 b"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in personal.report(docs).collect()}
    for i, t in enumerate(texts):
        want = ",".join("%s:%d:%d" % x for x in base_spans(t))
        assert (got[i].n_email, got[i].base_sha256, got[i].spans) == (1, sha(want), want)
    assert [r.text for r in personal.redact(docs).orderBy("doc_id").collect()] == ["[EMAIL]", "a [EMAIL] b"]


def test_redact(spark):
    docs = spark.createDataFrame([(1, "é mail a@b.com now", None, None, None), (2, None, None, None, None), (3, "", None, None, None), (4, "no", "x", "y", 2)], SCHEMA)
    got = {r.doc_id: r for r in personal.redact(docs).collect()}
    assert got[1].text == "é mail [EMAIL] now" and got[2].text is None and got[3].text == "" and got[4].asDict() == {"doc_id": 4, "text": "no", "lang": "x", "source": "y", "n_chars": 2}
    assert personal.redact(docs.limit(0)).count() == 0


def template(turns):
    esc = lambda s: s.replace("&", "&amp;").replace("<|", "&lt;|")
    return "".join(f"<|im_start|>{esc(r)}\n{esc(t)}<|im_end|>\n" for r, t in turns)


def test_chat_folds_and_reads_back(spark):
    log = [
        (1, 0, 0, "message", "user", "hi <|im_end|>\n<|im_start|>assistant ok &lt;| &amp; &"),
        (1, 1, 1, "message", "assistant", "par"), (1, 1, 2, "delta", "assistant", "t a"), (1, 1, 3, "delta", "assistant", "é😀"),
        (1, 2, 4, "message", "user", "more"), (1, 2, 5, "edit", "user", "better"),
        (1, 3, 6, "message", "assistant", "old"), (1, 3, 7, "regenerate", "assistant", ""), (1, 3, 8, "delta", "assistant", "ne"), (1, 3, 9, "delta", "assistant", "w"),
        (2, 0, 0, "message", None, None), (2, None, 0, "message", "system", ""), (2, 0, 0, "message", None, None), (None, 5, 1, "delta", "assistant", "alone"),
        (3, 0, 0, "message", "assistant", ""), (3, 1, 0, "message", "assistant", "z" * 5000),
    ]
    events = spark.createDataFrame(log, "conv_id bigint, turn bigint, seq bigint, kind string, role string, text string").withColumn("formatted", F.lit(1)).withColumn("no", F.lit(2))
    out = {r.conv_id: r for r in chat.read_back(chat.render(chat.messages(events))).collect()}
    want = {
        1: [("user", log[0][5]), ("assistant", "part aé😀"), ("user", "better"), ("assistant", "new")],
        2: [("system", ""), ("", ""), ("", "")], None: [("assistant", "alone")], 3: [("assistant", ""), ("assistant", "z" * 5000)],
    }
    assert set(out) == set(want)
    for k, turns in want.items():
        assert [(t.role, t.text) for t in out[k].turns] == turns
        assert out[k].formatted == template(turns)
        assert out[k].loss_text == "".join(t for r, t in turns if r == "assistant")
    assert chat.read_back(chat.render(chat.messages(events.limit(0)))).count() == 0


def level(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        goal = {s: 3.0 * sizes[s] if s in capped else rest * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if goal[s] > 3 * sizes[s]}
        if not over:
            return goal
        capped |= over


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_hits_targets(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "B", "é", "😀", "src10", "src2", "￮"][: 3 + 3 * (seed - 1) + 2]
    rows = [(i, " ".join(["w"] * int(rng.expovariate(1 / 300))) if rng.random() > 0.02 else None, "en", names[0] if rng.random() < 0.4 else rng.choice(names), 0) for i in range(900)]
    rows += [(5, "dup row", "en", "a", 0), (5, "dup row", "en", "a", 0), (None, "null id", None, "a", None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit(1)).withColumn("target", F.lit("x"))
    got = mixing.plan(docs, shard_words=5000).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(docs.repartition(7), shard_words=5000).collect()))
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source], taken[r.source] = sizes.get(r.source, 0) + r.size, taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
    goal = level(sizes)
    for r in got:
        assert r.target == pytest.approx(goal[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 0.01 * goal[s] + 256, (s, taken[s], goal[s])
    assert mixing.plan(docs.limit(0)).count() == 0


def test_highest_quotients(spark):
    rng = random.Random(3)
    votes = [("g%d" % (i % 3), "p%02d" % i, rng.choice([0.0, 1.5, 2.0, 7.0, 100.0, 1000.5]), [0, 17, 400][i % 3]) for i in range(60)]
    parties = spark.createDataFrame(votes, "g string, p string, v double, s bigint")
    got = {r.p: r.quota for r in mixing.apportion(parties, ["g"], ["p"], "v", "s").collect()}
    for g in range(3):
        own = [x for x in votes if x[0] == f"g{g}"]
        best = sorted(((-x[2] / (2 * k + 1), x[1], k) for x in own if x[2] > 0 for k in range(x[3])))[: own[0][3]]
        assert {x[1]: sum(b[1] == x[1] for b in best) for x in own} == {x[1]: got[x[1]] for x in own}
