"""String, coordinate and identifier scalars as native columns (STR-01 to STR-28, ENT-34 to ENT-36, SRC-35)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTER = r"^@[^ \t\n\r@]+@$"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
# Legacy multimedia formats with the media types that stand for them, and the other way round.
TO_MEDIA_TYPE = {
    "JPG": "image/jpeg", "JPEG": "image/jpeg", "PNG": "image/png", "GIF": "image/gif", "TIFF": "image/tiff", "TIF": "image/tiff", "BMP": "image/bmp", "MP3": "audio/mpeg", "WAV": "audio/wav",
    "MP4": "video/mp4", "MPEG": "video/mpeg", "MPG": "video/mpeg", "AVI": "video/x-msvideo", "PDF": "application/pdf", "TXT": "text/plain", "TEXT": "text/plain",
}
TO_LEGACY = {
    "image/jpeg": "JPG", "image/png": "PNG", "image/gif": "GIF", "image/tiff": "TIFF", "image/bmp": "BMP", "audio/mpeg": "MP3", "audio/wav": "WAV", "video/mp4": "MP4", "video/mpeg": "MPEG",
    "video/x-msvideo": "AVI", "application/pdf": "PDF", "text/plain": "TXT",
}
# Words in a source system's name, in order of priority, and the vendor they stand for.
VENDORS = (("ancestry", "ancestry"), ("familytreemaker", "ancestry"), ("familysearch", "familysearch"), ("rootsmagic", "rootsmagic"), ("legacy", "legacy"), ("gramps", "gramps"), ("myheritage", "myheritage"))
# What reports call the types of records.
RECORD_NAMES = {"INDI": "Individual", "FAM": "Family", "SOUR": "Source", "REPO": "Repository", "NOTE": "Note", "OBJE": "MediaObject", "SUBM": "Submitter", "HEAD": "Header", "TRLR": "Trailer"}


def trim_space(s: Column) -> Column:
    """White space of every kind off both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def _folds() -> tuple[str, str]:
    """The precomposed letters of the basic plane whose decomposition is a letter and marks, and those letters."""
    source, target = [], []
    for code in range(0xC0, 0x10000):
        char = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        parts = unicodedata.normalize("NFD", char)
        if len(parts) < 2 or unicodedata.category(parts[0]) == "Mn":
            continue
        kept = unicodedata.normalize("NFC", "".join(c for c in parts if unicodedata.category(c) != "Mn"))
        if kept != char and len(kept) == 1:
            source.append(char)
            target.append(kept)
    return "".join(source), "".join(target)


_FOLDS: list[tuple[str, str]] = []


def normalize_name(s: Column) -> Column:
    """STR-01: trimmed, lower case, without combining marks; letters like ø that do not decompose stay."""
    if not _FOLDS:
        _FOLDS.append(_folds())
    return F.regexp_replace(F.translate(F.lower(trim_space(s)), *_FOLDS[0]), r"\p{Mn}", "")


def similarity(a: Column, b: Column) -> Column:
    """STR-03: 1 less the edit distance in characters over the larger length in bytes; equal 1, else 0 if one is empty."""
    share = 1 - F.levenshtein(a, b) / F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(share)


def compare_given(a: Column, b: Column) -> Column:
    """STR-04: 0 if either is empty."""
    x, y = normalize_name(a), normalize_name(b)
    return F.when((x == "") | (y == ""), 0.0).otherwise(similarity(x, y))


def compare_surnames(a: Column, b: Column) -> Column:
    """STR-05: equality of normalised names; empty never matches."""
    return F.when((normalize_name(a) != "") & (normalize_name(a) == normalize_name(b)), 1.0).otherwise(0.0)


def surname_of(full: Column) -> Column:
    """STR-06: what is between the first and the last slash."""
    return F.trim(F.regexp_extract(full, "/(.*)/", 1))


def given_of(full: Column) -> Column:
    """STR-07: what is before the first slash."""
    return F.trim(F.substring_index(full, "/", 1))


def display_name(full: Column, given: Column, surname: Column, xref: Column) -> Column:
    """STR-08."""
    plain = F.trim(F.replace(F.replace(full, F.lit("/"), F.lit("")), F.lit("  "), F.lit(" ")))
    both = F.trim(F.concat_ws(" ", F.nullif(given, F.lit("")), F.nullif(surname, F.lit(""))))
    return F.coalesce(F.nullif(plain, F.lit("")), F.nullif(both, F.lit("")), xref)


def is_pointer(s: Column) -> Column:
    """STR-09."""
    return s.rlike(POINTER) & (s != "@VOID@")


def escape_at(s: Column) -> Column:
    """STR-10."""
    return F.when(F.startswith(s, F.lit("@")), F.concat(F.lit("@"), s)).otherwise(s)


def unescape_at(s: Column) -> Column:
    """STR-11."""
    return F.when(F.startswith(s, F.lit("@@")), F.substring(s, 2, 1_000_000_000)).otherwise(s)


def coordinate(s: Column) -> Column:
    """STR-12: N or E and a number, S or W for negative ones, white space around it apart; null for anything else."""
    s = trim_space(s)
    number = F.substring(s, 2, 1_000_000).try_cast("double")
    good = s.rlike(r"^[NSEWnsew](\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(good, F.when(F.upper(F.substring(s, 1, 1)).isin("S", "W"), -number).otherwise(number))


def coordinates(latitude: Column, longitude: Column) -> Column:
    """STR-13: struct (lat, long, error); both empty are (0, 0)."""
    latitude, longitude = trim_space(latitude), trim_space(longitude)
    lat, long = coordinate(latitude), coordinate(longitude)
    error = (
        F.when((latitude == "") & (longitude == ""), None).when((latitude == "") | (longitude == ""), "one coordinate is missing")
        .when(~F.upper(F.substring(latitude, 1, 1)).isin("N", "S"), "latitude needs N or S").when(~F.upper(F.substring(longitude, 1, 1)).isin("E", "W"), "longitude needs E or W")
        .when(lat.isNull() | long.isNull(), "invalid number").when(F.abs(lat) > 90, "latitude is out of range").when(F.abs(long) > 180, "longitude is out of range")
    )
    empty = (latitude == "") & (longitude == "")
    pick = lambda x: F.when(empty, 0.0).when(error.isNull(), x)
    return F.struct(pick(lat).alias("lat"), pick(long).alias("long"), error.alias("error"))


def coordinates_empty(latitude: Column, longitude: Column) -> Column:
    """STR-14."""
    return (trim_space(latitude) == "") & (trim_space(longitude) == "")


def id_number(xref: Column) -> Column:
    """STR-15: struct (prefix, number) of @letters123@, null for other forms."""
    form = r"^@([^0-9@]+)([0-9]+)@$"
    return F.when(xref.rlike(form), F.struct(F.regexp_extract(xref, form, 1).alias("prefix"), F.regexp_extract(xref, form, 2).try_cast("long").alias("number")))


def split_lines(s: Column) -> Column:
    """STR-19 and SRC-13: pieces between CRLF, LF and CR."""
    return F.split(s, "\r\n|\r|\n", -1)


def wrap(line: Column, most: int) -> Column:
    """STR-16 and STR-17: pieces of at most `most` bytes, cut behind the last space that fits, else between characters.

    The pieces are found in a text with one character for each byte of the line, which native expressions can count.
    """
    form = rf"(?s).{{1,{most}}}\z|.{{1,{most - 1}}} |.{{{max(1, most - 3)},{most}}}(?![\x80-\xBF])"
    by_byte = F.decode(F.encode(line, "UTF-8"), "ISO-8859-1")
    pieces = F.transform(F.regexp_extract_all(by_byte, F.lit(f"({form})"), F.lit(0)), lambda p: F.decode(F.encode(p, "ISO-8859-1"), "UTF-8"))
    return F.when(F.octet_length(line) <= most, F.array(line)).otherwise(pieces)


def _mapped(s: Column, table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def to_media_type(s: Column) -> Column:
    """STR-20: other values with a slash pass, other ones without give ''."""
    return F.coalesce(_mapped(s, TO_MEDIA_TYPE, F.upper(trim_space(s))), F.when(F.contains(s, F.lit("/")), s).otherwise(""))


def to_legacy_media(s: Column) -> Column:
    """STR-21: other values without a slash pass, other ones with give ''."""
    return F.coalesce(_mapped(s, TO_LEGACY, F.lower(trim_space(s))), F.when(F.contains(s, F.lit("/")), "").otherwise(s))


def path(*segments: Column) -> Column:
    """STR-22 and STR-24: the segments that are not empty, joined by ' > '."""
    return F.concat_ws(" > ", F.filter(F.array(*segments), lambda x: x.isNotNull() & (x != "")))


def record_path(kind: Column, xref: Column) -> Column:
    """STR-23: a record's label and its identifier."""
    table = F.create_map(*(F.lit(x) for pair in RECORD_NAMES.items() for x in pair))
    label = F.coalesce(F.try_element_at(table, kind), kind)
    return F.when(xref == "", label).otherwise(F.concat(label, F.lit(" "), xref))


def is_familysearch_ark(uri: Column) -> Column:
    """STR-25: the first occurrence decides."""
    low = F.lower(uri)
    after = F.substring(F.regexp_extract(low, r"(?s)^.*?familysearch\.org/ark(.*)$", 1), 1, 1)
    return F.contains(low, F.lit("familysearch.org/ark")) & after.isin("", ":", "/")


def control_position(s: Column) -> Column:
    """STR-28: byte position (from 0) of the first control character but TAB, LF and CR; null if there is none."""
    at = F.regexp_instr(s, F.lit(CONTROL))
    return F.when(at > 0, F.octet_length(F.left(s, at - 1)))


def apid(value: Column) -> Column:
    """ENT-34: struct (prefix, database, record) of [x,]db::rec, null for other forms."""
    form = r"^(?:([^,]*),)?([^,]*?)::(.+)$"
    good = value.rlike(form) & (F.regexp_extract(value, form, 2) != "")
    return F.when(good, F.struct(*(F.regexp_extract(value, form, i).alias(n) for i, n in ((1, "prefix"), (2, "database"), (3, "record")))))


def apid_url(value: Column) -> Column:
    """ENT-35."""
    x = apid(value)
    return F.concat(F.lit("https://www.ancestry.com/discoveryui-content/view/"), x["record"], F.lit(":"), x["database"])


def familysearch_url(identifier: Column) -> Column:
    """ENT-36: '' without an identifier."""
    return F.when(identifier != "", F.concat(F.lit("https://www.familysearch.org/tree/person/details/"), identifier)).otherwise("")


def vendor(source_system: Column) -> Column:
    """SRC-35."""
    low, found = F.lower(source_system), F.lit("unknown")
    for word, name in reversed(VENDORS):
        found = F.when(F.contains(low, F.lit(word)), name).otherwise(found)
    return found
