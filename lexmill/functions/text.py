"""Column functions on text: cleaning, counting, normalising, formatting. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters or digits, also joined by one of - . /
TOKEN = r"[\p{L}\p{N}]+(?:[-./][\p{L}\p{N}]+)*"
ARABIC = r"[؀-ۿ]"

# A line that holds only a page number, in the spellings found on scanned pages.
PAGE_LINE = (
    r"(?imu)^[ \t]*(?:"
    r"page[ \t]*(?:n[°º][ \t]*)?[0-9]+(?:[ \t]*(?:/|sur|of)[ \t]*[0-9]+)?"
    r"|(?:صفحة|الصفحة)[ \t]*[0-9٠-٩]+(?:[ \t]*(?:/|من)[ \t]*[0-9٠-٩]+)?"
    r"|-{1,2}[ \t]*[0-9]+[ \t]*-{1,2}"
    r"|[0-9]+[ \t]*(?:/|sur|of|من)[ \t]*[0-9]+"
    r")[ \t]*$"
)


def unify_newlines(t: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(t, "\r\n?", "\n")


def strip_controls(t: Column) -> Column:
    """Control characters but for line feed and tab removed."""
    return F.regexp_replace(t, "[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F]", "")


def collapse_blanks(t: Column) -> Column:
    """Runs of blanks and tabs become one blank."""
    return F.regexp_replace(t, "[ \t]+", " ")


def drop_page_lines(t: Column) -> Column:
    """Lines that hold only a page number emptied."""
    return F.regexp_replace(t, PAGE_LINE, "")


def trim_all(t: Column) -> Column:
    """Blanks, tabs and line ends at both ends removed; trim() alone removes only blanks."""
    return F.regexp_replace(F.regexp_replace(t, r"^[ \t\r\n]+", ""), r"[ \t\r\n]+$", "")


def collapse_blank_lines(t: Column) -> Column:
    """At most one empty line in a row; none at the ends."""
    return trim_all(F.regexp_replace(t, "\n{3,}", "\n\n"))


def script_language(t: Column) -> Column:
    """ar if there is an Arabic letter, else fr: the rule by which documents are labelled on ingestion."""
    return F.when(t.rlike(ARABIC), "ar").otherwise("fr")


def words(t: Column) -> Column:
    """White-space separated tokens as an array."""
    return F.regexp_extract_all(t, F.lit(r"[^ \t\r\n\f]+"), F.lit(0))


def word_count(t: Column) -> Column:
    return F.when(t.isNull(), 0).otherwise(F.size(words(t)))


def lexical_tokens(t: Column) -> Column:
    """Lower-case tokens of letters and digits, for lexical search."""
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN), F.lit(0))


def detokenise(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def excerpt(t: Column, most: int = 500) -> Column:
    """White space collapsed; cut to ``most`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)


def shorten(t: Column, most: int = 60) -> Column:
    """Cut for display, with three dots."""
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def normal_question(t: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(t)), r"[ \t\r\n]+", " ")


def cache_key(question: Column, filters: Column | None = None) -> Column:
    """Key of a cached response: the question in lower case, and the filters if any."""
    base = F.lower(F.trim(question))
    return F.sha2(base if filters is None else F.concat_ws("\x1f", base, filters), 256)


def keyed_fingerprint(message: Column, key: Column) -> Column:
    """First 32 hexadecimal digits of HMAC-SHA-256, from the two nested hashes; a key of more than 64 bytes is hashed first."""
    own = F.hex(F.encode(key, "UTF-8"))
    raw = F.rpad(F.when(F.length(own) > 128, F.upper(F.sha2(F.encode(key, "UTF-8"), 256))).otherwise(own), 128, "0")

    def pad(byte: str) -> Column:
        codes = F.sequence(F.lit(0), F.lit(63))
        return F.unhex(F.array_join(F.transform(codes, lambda i: F.lpad(F.lower(F.hex(F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(int(byte, 16))))), 2, "0")), ""))

    inner = F.unhex(F.sha2(F.concat(pad("36"), F.encode(message, "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(pad("5c"), inner), 256), 1, 32)


def byte_size(n: Column) -> Column:
    """Bytes in o, Ko, Mo, Go with one decimal, base 1024."""
    out = F.concat(n.cast("bigint").cast("string"), F.lit(" o"))
    for unit, power in (("Ko", 1), ("Mo", 2), ("Go", 3)):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f", n / float(1024**power)), F.lit(f" {unit}"))).otherwise(out)
    return out


def initials(t: Column) -> Column:
    """First letters of the first two words, in capitals."""
    return F.upper(F.array_join(F.transform(F.slice(words(t), 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def progress(stage: Column, last: int) -> Column:
    return F.round(F.lit(100.0) * stage / F.lit(float(last))).cast("int")


def serialise_map(m: Column) -> Column:
    """A map as k=v pairs in the order of the keys, comma separated."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def slug(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(t), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def document_id(path: Column, source: Column) -> Column:
    """Slug of the source and 16 digits of the SHA-1 of the relative path."""
    return F.concat(source, F.lit("-"), F.substring(F.sha1(path), 1, 16))


def chunk_id(*parts: Column) -> Column:
    """SHA-256 over the parts, white space collapsed, with unit separators between."""
    return F.sha2(F.concat_ws("\x1f", *[F.trim(F.regexp_replace(F.coalesce(p.cast("string"), F.lit("")), r"[ \t\r\n]+", " ")) for p in parts]), 256)


def long_date(d: Column, locale: str = "fr") -> Column:
    """Day, month name and year."""
    months = {
        "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
        "ar": "يناير فبراير مارس أبريل ماي يونيو يوليوز غشت شتنبر أكتوبر نونبر دجنبر",
    }[locale].split()
    names = F.array(*[F.lit(m) for m in months])
    return F.concat_ws(" ", F.dayofmonth(d).cast("string"), F.element_at(names, F.month(d)), F.year(d).cast("string"))


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def contains_all(hay: Column, query: Column) -> Column:
    """Whether every word of the query is in the text, case left aside."""
    return F.forall(words(F.lower(query)), lambda w: F.contains(F.lower(hay), w))


def pipeline(t: Column, *steps) -> Column:
    return reduce(lambda c, f: f(c), steps, t)
