"""Text functions as Spark columns: tokens, fingerprints, estimates, previews, codecs."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.split`` and ``str.strip`` see it.
_WS = r"[\s\x1C-\x1F\x85   -     　]"


def folding(first: int = 0xC0, last: int = 0x24F) -> tuple[str, str]:
    """Latin letters with diacritics and the letters without, by canonical decomposition."""
    marked, plain = [], []
    for code in [*range(first, last + 1), *range(0x1E00, 0x1F00)]:
        low = chr(code).lower()
        parts = unicodedata.normalize("NFD", low)
        if len(low) == 1 and len(parts) > 1 and parts[0].isascii() and parts[0].isalpha() and all(map(unicodedata.combining, parts[1:])) and low not in marked:
            marked.append(low)
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = folding()


def tokens(text: Column, fold: bool = True) -> Column:
    """Lower-case runs of letters and digits; ``fold`` removes diacritics of Latin letters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    if fold:
        low = F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, _MARKED, _PLAIN))  # ASCII has nothing to fold
    return F.array_remove(F.split(low, r"[^\p{L}\p{N}]+"), "")


def tokens_of(text: str, fold: bool = True) -> list[str]:
    """``tokens`` for a query string on the driver."""
    low = text.lower()
    if fold:
        low = low.translate(str.maketrans(_MARKED, _PLAIN))
    out, run = [], ""
    for c in low:
        if unicodedata.category(c)[0] in "LN":
            run += c
        elif run:
            out.append(run)
            run = ""
    return [*out, run] if run else out


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def strip(text: Column) -> Column:
    """Removes Unicode white space at both ends."""
    return F.regexp_replace(text, f"^{_WS}+|{_WS}+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, f"{_WS}+", " "))


def content_fingerprint(text: Column) -> Column:
    return F.sha2(strip(unix_lines(text)), 256)


def file_hash(text: Column) -> Column:
    return F.sha2(unix_lines(text), 256)


def json_string(value: Column) -> Column:
    """A JSON string literal that leaves non-ASCII text as it is."""
    return F.regexp_replace(F.to_json(F.struct(value.cast("string").alias("v"))), r'^\{"v":|\}$', "")


def logical_id(kind: str, *parts: Column) -> Column:
    """``kind_`` and 32 hex digits of the SHA-256 of the parts as a compact JSON array."""
    body = F.concat(F.lit("["), F.concat_ws(",", *(json_string(p) for p in parts)), F.lit("]"))
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(body, 256), 1, 32))


def safe_fingerprint(value: Column) -> Column:
    """``sha256:`` and the hash of a value that must not be shown."""
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


MEDIA_KINDS = ("resource", "representation", "atom", "passage", "frame", "whole")


def stable_media_id(kind: str, contract: str, *parts: Column) -> Column:
    """``kind_`` and the SHA-256 of the canonical JSON of contract, kind and parts; the contract's name is the caller's."""
    if kind not in MEDIA_KINDS or not parts:
        raise ValueError("a media id has a known kind and at least one part")
    body = F.concat(F.lit('{"contract":'), json_string(F.lit(contract)), F.lit(f',"kind":"{kind}","parts":['), F.concat_ws(",", *(json_string(p) for p in parts)), F.lit("]}"))
    return F.concat(F.lit(f"{kind}_"), F.sha2(body, 256))


def heading_key(path: Column) -> Column:
    """Heading path for comparisons: white space collapsed, lower case."""
    return F.transform(path, lambda x: F.lower(collapse(x)))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.floor((F.octet_length(text) + 3) / 4)).cast("long")


def count_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{_WS}+"), lambda t: t != "")).cast("long")


def preview(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def seconds_to_ms(seconds: Column) -> Column:
    """Decimal seconds to whole milliseconds, halves up; null where not a number."""
    return F.round(seconds.try_cast("decimal(30,12)") * 1000, 0).cast("long")


def clock_to_ms(clock: Column) -> Column:
    """``[H..H:]MM:SS[.,]mmm`` in milliseconds; null where malformed."""
    part = lambda i: F.regexp_extract(clock, r"^(?:(\d+):)?([0-5]\d):([0-5]\d)[.,](\d{3})$", i)
    hours = F.when(part(1) == "", F.lit(0)).otherwise(part(1).try_cast("long"))
    return F.when(part(2) != "", ((hours * 60 + part(2).try_cast("long")) * 60 + part(3).try_cast("long")) * 1000 + part(4).try_cast("long"))


def facet_text(value: Column) -> Column:
    """A string facet value: ``s:`` and the percent-encoded text, only unreserved characters left."""
    quoted = F.url_encode(value)
    for old, new in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        quoted = F.replace(quoted, F.lit(old), F.lit(new))
    return F.concat(F.lit("s:"), quoted)


def facet_value(value: Column, kind: str) -> Column:
    """Typed facet text of a column of ``kind`` string, int, bool or null."""
    if kind == "string":
        return F.when(value.isNull(), F.lit("z:null")).otherwise(facet_text(value))
    if kind == "int":
        return F.when(value.isNull(), F.lit("z:null")).otherwise(F.concat(F.lit("i:"), value.cast("long").cast("string")))
    if kind == "bool":
        return F.when(value.isNull(), F.lit("z:null")).otherwise(F.concat(F.lit("b:"), value.cast("string")))
    raise ValueError(f"no facet kind {kind}")


def facet_display(value: Column) -> Column:
    """The text that a facet value stands for."""
    body = F.substring(value, 3, 1 << 30)
    return F.when(value.startswith("s:"), F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B")))).when(value.startswith("z:"), F.lit(None).cast("string")).when(facet_type(value).isNotNull(), body).otherwise(value)


def facet_type(value: Column) -> Column:
    names = {"s": "string", "i": "integer", "f": "float", "b": "boolean", "z": "null"}
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(F.substring(value, 1, 2) == f"{k}:", F.lit(v)).otherwise(out)
    return out


def embedding_text(heading_path: Column, kind: Column, language: Column, text: Column) -> Column:
    """Text to embed: heading path, a tag for blocks that are not prose, the text."""
    path = F.when(F.size(heading_path) > 0, F.array_join(heading_path, " > "))
    tag = F.when(kind == "code", F.concat(F.lit("[code"), F.coalesce(F.concat(F.lit(":"), language), F.lit("")), F.lit("]"))).when(kind == "mermaid", F.lit("[mermaid diagram]")).when(kind.isin("table", "list", "quote", "callout"), F.concat(F.lit("["), kind, F.lit("]")))
    return F.concat_ws("\n", path, tag, text)
