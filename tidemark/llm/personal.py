"""PII spans: regular expressions propose, checksum validators confirm, context words score.

Base kinds (email, ip, card, phone) are always kept once their own check passes. Further kinds (iban,
ssn, account) need a score of MIN_SCORE, to which checksums and context words in the CONTEXT
characters before and after the span add. Offsets count code points, ends are exclusive. A null
or empty text has no spans; rows are independent, so repeated rows give equal results, and extra
columns pass through spans() and redact() unchanged.

The patterns are linear forms of the plain ones: possessive runs, and a start only where the
previous match ended or a run begins, since a run that fails at its start fails at every place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "account": r"\b[0-9]{12,15}\b",
}
#: A kind is looked for only in texts that have this.
NEEDS = {
    "email": "@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){15}",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "account": r"[0-9]{12}",
}
WORDS = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|master|amex|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|konto|bank|transfer",
    "ssn": "ssn|social|security",
    "account": "card|visa|amex|credit|debit|account|konto",
}
CHECKED = {"card": 0.4, "iban": 0.6, "account": 0.2}
START, NEAR, MIN_SCORE, CONTEXT = 0.3, 0.3, 0.8, 48


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """True if the digits of value, every second from the right doubled, sum to a multiple of 10."""
    turned = F.reverse(digits(value))
    figures = F.transform(F.split(turned, "(?<=.)(?=.)"), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") / 5).cast("int")))
    return F.aggregate(figures, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """True if value, four leading characters moved to the end and letters read as 10 to 35, is 1 mod 97."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4))
    one = lambda x: F.when(x.rlike("[0-9]"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
    return F.aggregate(F.split(moved, "(?<=.)(?=.)"), F.lit(0), lambda a, x: (a * F.when(x.rlike("[0-9]"), 10).otherwise(100) + one(x)) % 97) == 1


def confirmed(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: (F.length(F.regexp_replace(x, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(x, "^0+", "").try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(value)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        return mod97(value)
    return luhn(value) if kind == "account" else F.lit(True)


def found(text: Column, kind: str) -> Column:
    """Confirmed matches of a kind as structs (kind, start, end, value, score). Pieces between
    matches and the matches themselves give the offsets."""
    pattern = PATTERNS[kind]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    steps = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), hits.alias("value"))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,score:double>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["value"]), F.lit(0))
        lead = F.greatest(start - CONTEXT, F.lit(0))
        around = F.lower(F.concat(F.substring(text, lead + 1, start - lead), F.lit(" "), F.substring(text, end + 1, F.lit(CONTEXT))))
        score = F.lit(START + CHECKED.get(kind, 0.3 if kind in BASE else 0.2)) + F.when(around.rlike(rf"(?<![a-z])(?:{WORDS[kind]})"), NEAR).otherwise(0.0)
        new = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value"), score.alias("score")))
        kept = x["value"].isNotNull() & confirmed(kind, x["value"])
        return F.struct(end.alias("at"), F.when(kept, F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    kept = folded if kind in BASE else F.filter(folded, lambda x: x["score"] >= MIN_SCORE)
    return F.when(text.rlike(NEEDS[kind]), kept).otherwise(empty)


def spans(docs: DataFrame) -> DataFrame:
    """docs with `spans`: all spans by kind in the order of PATTERNS, then start."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("spans", F.concat(*[found(text, kind) for kind in PATTERNS]))


def digest(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, the digest of the base spans and all spans as text."""
    marked = spans(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).drop("text")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return marked.select("doc_id", *map(count, BASE), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in brackets; of overlapping spans the first stands
    for what it covers and the rest of the later ones goes too."""
    marked = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    marked = spans(marked)
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"], x["end"], x["kind"])))

    def step(acc: Column, x: Column) -> Column:
        new = F.concat(F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    clean = marked.withColumn("f", folded)
    text = F.when(F.size("spans") > 0, F.concat(F.col("f.out"), F.expr("substring(text, f.at + 1)"))).otherwise(F.col("text"))
    return clean.select(*(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
