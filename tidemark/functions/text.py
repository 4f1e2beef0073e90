"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Question words that name no activity.
STOPWORDS = (
    "a about after all am an and any anything are as at be been before by can could did do does doing during for from had has have how i if in into is it its me my of "
    "on or so some than that the their them then there these this those to was we were what when where which while who whom why will with would you your"
).split()
#: Cues of a question's shape, and words too common to tie it to one media item.
OVERVIEW_CUES = ("most of", "mostly", "most time", "spend", "spent", "whole evening", "all evening", "all day", "what projects", "which projects", "what was i doing", "what have i been doing", "busy with")
LATEST_CUES = ("last ", "latest", "most recent", "recently")
MEDIA_CUES = ("watch", "episode", "video", "movie", "show", "listen", "song", "music", "played", "youtube")
WORK_CUES = ("project", "work", "build", "code")
PLAYER_APPS = ("vlc", "mpv", "totem", "celluloid", "spotify")
GENERIC_WORDS = (
    "what which who did the and was were watch watched watching video videos episode episodes show listen played made posted"
).split()
TEXT_TYPES = ("text/", "application/json", "application/xml", "application/xhtml+xml", "application/atom+xml", "application/rss+xml", "application/markdown")

NOT_WORD = r"[^\p{L}\p{N}]+"


def any_of(text: Column, cues: tuple[str, ...] | list[str]) -> Column:
    out = F.lit(False)
    for cue in cues:
        out = out | text.contains(cue)
    return out


def words(text: Column) -> Column:
    """Runs of letters and digits, in order."""
    return F.filter(F.split(text, NOT_WORD), lambda w: w != "")


def query_terms(question: Column) -> Column:
    """Lower-case words without stop words; repeats stay."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(words(F.lower(question)), lambda w: ~F.array_contains(stop, w))


def stem(term: Column) -> Column:
    """The term without the first of ing, ed, es, s that leaves three bytes or more."""
    out = term
    for suffix in ("s", "es", "ed", "ing"):
        out = F.when(term.endswith(suffix) & (F.octet_length(term) >= len(suffix) + 3), F.left(term, F.length(term) - len(suffix))).otherwise(out)
    return out


def terms_matched(terms: Column, text: Column) -> Column:
    """How many terms (repeats counted) have their stem in the lower-cased text."""
    return F.size(F.filter(terms, lambda t: F.contains(F.lower(text), stem(t)))).cast("long")


def search_aliases(text: Column) -> Column:
    """Dotted acronyms joined, and `reddit subreddit` for each word r/..., by one space."""
    def of(word: Column) -> Column:
        parts = F.filter(F.split(word, r"\."), lambda p: p != "")
        acronym = F.when((F.size(parts) >= 3) & F.forall(parts, lambda p: F.length(p) == 1), F.array(F.array_join(parts, ""))).otherwise(F.array().cast("array<string>"))
        forum = F.when(word.startswith("r/") & (F.length(word) > 2), F.array(F.lit("reddit subreddit"))).otherwise(F.array().cast("array<string>"))
        return F.concat(acronym, forum)

    every = F.array_join(F.flatten(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), of)), " ")
    return F.when(text.rlike(r"\.\S+\.|(?:^|\s)r/\S"), every).when(text.isNotNull(), "")  # most texts have none


def intent(question: Column) -> Column:
    """struct(intent, before, anchor): Around (with what follows the first before or after), Overview,
    Latest or Specific."""
    q = F.lower(question)
    anchor = lambda cue: F.trim(F.regexp_replace(F.when(q.contains(cue), F.substring(q, F.locate(cue, q) + len(cue), F.length(q))), r"[?.!]+$", ""))
    before, after = anchor(" before "), anchor(" after ")
    row = lambda kind, side, text: F.struct(F.lit(kind).alias("intent"), F.lit(side).cast("boolean").alias("before"), text.cast("string").alias("anchor"))
    none = F.lit(None)
    return (
        F.when(before != "", row("around", True, before)).when(after != "", row("around", False, after))
        .when(any_of(q, OVERVIEW_CUES), row("overview", None, none)).when(any_of(q, LATEST_CUES), row("latest", None, none)).otherwise(row("specific", None, none))
    )


def proper_nouns(question: Column) -> Column:
    """Words after the first that begin with a capital, other than I, in lower case."""
    own = words(question)
    return F.transform(F.filter(F.slice(own, 2, F.greatest(F.size(own), F.lit(1))), lambda w: (w != "I") & w.rlike(r"^\p{Lu}")), F.lower)


def media_words(question: Column) -> Column:
    generic = F.array(*map(F.lit, GENERIC_WORDS))
    return F.filter(words(F.lower(question)), lambda w: (F.octet_length(w) > 2) & ~F.array_contains(generic, w))


def media_window(app: Column, text: Column) -> Column:
    return any_of(F.lower(app), PLAYER_APPS) | text.contains("YouTube")


def minutes(ms: Column) -> Column:
    return F.floor((ms + 30_000) / 60_000)


def timestamped(text: Column, t_ns: Column, zone: str = "UTC") -> Column:
    """`[HH:MM] text` in a zone, for a known time."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_micros(F.floor(t_ns / 1000)).cast("timestamp_ntz"))
    return F.when(t_ns > 0, F.concat(F.lit("["), F.date_format(local, "HH:mm"), F.lit("] "), text)).otherwise(text)


def utc_label(t_ns: Column) -> Column:
    """YYYYMMDDTHHMMSSZ; the session's zone must be UTC."""
    return F.date_format(F.timestamp_micros(F.floor(t_ns / 1000)), "yyyyMMdd'T'HHmmss'Z'")


def truncate_bytes(text: Column, most: Column | int) -> Column:
    """The longest prefix of whole characters within `most` bytes: a cut inside a character leaves
    up to three bytes of it, which are dropped."""
    most = F.lit(most) if isinstance(most, int) else most
    raw = F.encode(text, "UTF-8")
    whole = F.lit("")
    for back in (3, 2, 1, 0):
        n = F.greatest(most - back, F.lit(0))
        ends = F.coalesce(~F.hex(F.substring(raw, n + 1, F.lit(1))).rlike("^[89AB]"), F.lit(True))
        whole = F.when(ends, F.substring(raw, F.lit(1), n).cast("string")).otherwise(whole)
    return F.when(F.octet_length(text) <= most, text).otherwise(whole)


def text_type(content_type: Column) -> Column:
    """True for a content type that is text, or none at all."""
    essence = F.lower(F.trim(F.split(content_type, ";")[0]))
    out = content_type == ""
    for allowed in TEXT_TYPES:
        out = out | essence.startswith(allowed)
    return out


def normal_title(title: Column) -> Column:
    """The title without leading status signs and trailing white space."""
    return F.regexp_replace(F.regexp_replace(title, r"""^[^\p{L}\p{N}~/.(\["'#@]+""", ""), r"\s+$", "")
