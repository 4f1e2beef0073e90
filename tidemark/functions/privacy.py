"""Privacy and provenance as column expressions: pseudonyms, taints and safe text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Applications whose events are dropped unless the defaults are off.
EXCLUDED = (
    "org.keepassxc.KeePassXC", "com.bitwarden.desktop", "1password", "com.1password.1Password", "org.gnome.World.Secrets", "org.qtpass.QtPass", "keepass", "keepassx", "keepassxc",
)
EXTERNAL, MODEL, KNOWN = 1, 4, 15


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex, made of two sha2 calls over padded blocks; message is binary."""
    key = key.ljust(64, b"\0")
    if len(key) > 64:
        raise ValueError("the key has at most 64 bytes")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message), 256))), 256)


def placeholder(key: bytes, kind: str, value: Column) -> Column:
    """kind-hash with 16 hex digits of a keyed hash of the kind (after its length) and the value; the empty
    string stays."""
    head = F.unhex(F.lit((len(kind).to_bytes(8, "little") + kind.encode()).hex()))
    return F.when(value == "", "").otherwise(F.concat(F.lit(f"{kind}-"), F.left(hmac_sha256(key, F.concat(head, F.encode(value, "UTF-8"))), F.lit(16))))


def anonymous_path(key: bytes, path: Column) -> Column:
    """/anon/hash.ext; the extension stays, if there is one after the last dot of the name."""
    ext = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    hashed = F.regexp_extract(placeholder(key, "path", path), "-(.*)", 1)
    return F.when(path == "", "").otherwise(F.concat(F.lit("/anon/"), hashed, F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))))


def escalates(taint: Column) -> Column:
    return taint.bitwiseAND(EXTERNAL) == EXTERNAL


def known_bits(taint: Column) -> Column:
    return taint.bitwiseAND(KNOWN)


def escape_xml(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def wrapped(text: Column, taint: Column) -> Column:
    """Text of external origin, escaped and marked as such."""
    return F.when(escalates(taint), F.concat(F.lit('<untrusted_external_doc taint="true">'), escape_xml(text), F.lit("</untrusted_external_doc>"))).otherwise(text)


def defused(text: Column) -> Column:
    """Text in which no chat control token can be read."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def tier(enabled: Column, base: Column, taint: Column) -> Column:
    """DENY for a disabled capability, REVIEW for a safe one on tainted input, else its own tier."""
    return F.when(~enabled, "DENY").when((base == "SAFE") & escalates(taint), "REVIEW").otherwise(base)
