"""Character sets: sniffing, decoding and validation (SRC-04 to SRC-12).

Everything is native; only the place of the first invalid byte, of files that have one, is found in Python. UTF-16 comes with a byte
order mark.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from kinloom.shipping import ship

CHAR_TAG = r"(?i)[\r\n]1\s+CHAR\s+(\S+)"
NAMES = {"ANSEL": "ANSEL", "ASCII": "UTF-8", "UTF-8": "UTF-8", "UNICODE": "UTF-8", "UTF-16": "UTF-16", "UTF-16LE": "UTF-16LE", "UTF-16BE": "UTF-16BE", "LATIN1": "ISO-8859-1", "ISO-8859-1": "ISO-8859-1", "ANSI": "ISO-8859-1"}
# The characters of the ANSEL standard (ANSI/NISO Z39.47) from 0xA1 on, and its combining marks from 0xE0 on.
SPACING = {
    0xA1: 0x0141, 0xA2: 0x00D8, 0xA3: 0x0110, 0xA4: 0x00DE, 0xA5: 0x00C6, 0xA6: 0x0152, 0xA7: 0x02B9, 0xA8: 0x00B7, 0xA9: 0x266D, 0xAA: 0x00AE, 0xAB: 0x00B1, 0xAC: 0x01A0, 0xAD: 0x01AF, 0xAE: 0x02BC,
    0xB0: 0x02BB, 0xB1: 0x0142, 0xB2: 0x00F8, 0xB3: 0x0111, 0xB4: 0x00FE, 0xB5: 0x00E6, 0xB6: 0x0153, 0xB7: 0x02BA, 0xB8: 0x0131, 0xB9: 0x00A3, 0xBA: 0x00F0, 0xBC: 0x01A1, 0xBD: 0x01B0, 0xBE: 0x25A1, 0xBF: 0x25A0,
    0xC0: 0x00B0, 0xC1: 0x2113, 0xC2: 0x2117, 0xC3: 0x00A9, 0xC4: 0x266F, 0xC5: 0x00BF, 0xC6: 0x00A1, 0xC7: 0x00DF, 0xC8: 0x20AC, 0xCD: 0x0065, 0xCE: 0x006F, 0xCF: 0x00DF,
}
COMBINING = {
    0xE0: 0x0309, 0xE1: 0x0300, 0xE2: 0x0301, 0xE3: 0x0302, 0xE4: 0x0303, 0xE5: 0x0304, 0xE6: 0x0306, 0xE7: 0x0307, 0xE8: 0x0308, 0xE9: 0x030C, 0xEA: 0x030A, 0xEB: 0xFE20, 0xEC: 0xFE21, 0xED: 0x0315,
    0xEE: 0x030B, 0xEF: 0x0310, 0xF0: 0x0327, 0xF1: 0x0328, 0xF2: 0x0323, 0xF3: 0x0324, 0xF4: 0x0325, 0xF5: 0x0333, 0xF6: 0x0332, 0xF7: 0x0326, 0xF8: 0x031C, 0xF9: 0x032E, 0xFA: 0x0360, 0xFB: 0x0361, 0xFE: 0x0313,
}


def bom(content: Column) -> Column:
    """SRC-05: the encoding that a byte order mark tells, '' without one."""
    head = F.hex(F.substring(content, 1, 3))
    return F.when(F.startswith(head, F.lit("FFFE")), "UTF-16LE").when(F.startswith(head, F.lit("FEFF")), "UTF-16BE").when(head == "EFBBBF", "UTF-8").otherwise("")


def char_tag(content: Column) -> Column:
    """SRC-06: the encoding that the CHAR line among the first 1000 bytes names, '' without one; unknown names mean UTF-8."""
    name = F.upper(F.regexp_extract(F.decode(F.substring(content, 1, 1000), "ISO-8859-1"), CHAR_TAG, 1))
    table = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    return F.when(name == "", "").otherwise(F.coalesce(F.try_element_at(table, name), F.lit("UTF-8")))


def encoding(content: Column) -> Column:
    """SRC-04: a byte order mark for UTF-16 wins, then the CHAR line, else UTF-8."""
    mark = bom(content)
    return F.when(mark.isin("UTF-16LE", "UTF-16BE"), mark).otherwise(F.coalesce(F.nullif(char_tag(content), F.lit("")), F.lit("UTF-8")))


def _ansel(content: Column) -> Column:
    """SRC-09: marks go behind the letter they precede; bytes that the standard does not define are an error (null).

    With one character for each byte, moving the marks is a pattern and naming the characters a translation.
    """
    text = F.decode(content, "ISO-8859-1")
    known = {b: chr(b) for b in range(0x80)} | {b: chr(c) for b, c in (SPACING | COMBINING).items()}
    undefined = "".join(f"\\x{{{b:x}}}" for b in range(256) if b not in known)
    marks = "".join(f"\\x{{{b:x}}}" for b in COMBINING)
    moved = F.regexp_replace(text, f"([{marks}]+)([^{marks}])", "$2$1")
    above = [b for b in known if b >= 0x80]
    return F.when(~text.rlike(f"[{undefined}]"), F.translate(moved, "".join(map(chr, above)), "".join(known[b] for b in above)))


def decode(content: Column, name: Column) -> Column:
    """SRC-07 and SRC-08: the text of bytes in an encoding, without a byte order mark; null for bytes that are not valid."""
    plain = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, 2_000_000_000)).otherwise(content)
    wide = F.when(bom(content).isin("UTF-16LE", "UTF-16BE"), F.substring(content, 3, 2_000_000_000)).otherwise(content)
    utf8 = plain.cast("string")
    return (
        F.when(name == "ISO-8859-1", F.decode(content, "ISO-8859-1")).when(name == "UTF-16LE", F.decode(wide, "UTF-16LE")).when(name.isin("UTF-16BE", "UTF-16"), F.decode(wide, "UTF-16BE"))
        .when(name == "ANSEL", _ansel(content)).when(F.is_valid_utf8(utf8), utf8)
    )


def is_valid(s: Column) -> Column:
    """SRC-12."""
    return F.is_valid_utf8(s)


def first_invalid(data: bytes) -> tuple[int, int] | None:
    """SRC-11: (line, byte column) of the first bad byte, both from 1; None for valid UTF-8."""
    try:
        data.decode()
        return None
    except UnicodeDecodeError as error:
        before = data[: error.start].replace(b"\r\n", b"\n").replace(b"\r", b"\n")
        return before.count(b"\n") + 1, len(before) - (before.rfind(b"\n") + 1) + 1


def _position(content: Column) -> Column:
    ship(SparkSession.active())

    def run(data: pd.Series) -> pd.DataFrame:
        found = [first_invalid(d) if d is not None else None for d in data]
        return pd.DataFrame({"line": pd.array([f and f[0] for f in found], "Int32"), "column": pd.array([f and f[1] for f in found], "Int32")})

    return F.pandas_udf(run, "struct<line:int,column:int>")(content)


def invalid_position(content: Column) -> Column:
    """SRC-11 as a column: null for valid bytes."""
    return F.when(~F.is_valid_utf8(content.cast("string")), _position(content))


def is_combining(byte: Column) -> Column:
    """SRC-10."""
    return byte.between(224, 254)
