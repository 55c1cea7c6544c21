"""Column expressions for spelling, paths, names and safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that Python's str.split and str.strip also remove.
BLANKS = r"[\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

BLANK_CHARS = "".join(chr(x) for x in (*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove every kind of blank from both ends, not only the space."""
    return F.trim(col(c), F.lit(BLANK_CHARS))


def missing_to_null(c: Column | str) -> Column:
    """Null for null, empty and blank-only strings; otherwise the string itself."""
    return F.when(F.length(strip(c)) > 0, col(c))


def spelled(c: Column | str) -> Column:
    """One spelling for texts that differ only in case and padding; null if missing."""
    s = F.lower(strip(c))
    return F.when(F.length(s) > 0, s)


def normalize_name(c: Column | str) -> Column:
    """Lower case with everything but ASCII letters and digits removed."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")


def base_name(c: Column | str) -> Column:
    """Last part of a slash-separated path."""
    return F.substring_index(col(c), "/", -1)


def suffix(c: Column | str) -> Column:
    """Extension with its dot; empty for none and for dot files."""
    return F.regexp_extract(base_name(c), r"^.+?(\.[^.]*)$", 1)


def stem(c: Column | str) -> Column:
    """File name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(base_name(c), r"(?<=.)\.[^.]*$", "")


def parent_name(c: Column | str) -> Column:
    """Name of the directory that holds the file, empty at the top."""
    parts = F.split(col(c), "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))


def collapse_blanks(c: Column | str) -> Column:
    """Drop NUL characters and fold runs of blanks to one space; null becomes empty."""
    no_nul = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\x00", "")
    return strip(F.regexp_replace(no_nul, f"{BLANKS}+", " "))


def photo_id(c: Column | str) -> Column:
    """Key of a photograph in a published leaf map.

    The mask suffix goes, the part after the last triple underscore and before
    the first "copy" stays, picture extensions go wherever they stand.
    """
    x = F.element_at(F.split(F.replace(base_name(c), F.lit("_final_masked"), F.lit("")), "___"), -1)
    x = F.element_at(F.split(x, "copy"), 1)
    return F.lower(strip(F.regexp_replace(x, r"\.jpg|\.JPG|\.png|\.PNG", "")))


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """a / b, and 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Number of differing bits of two 64-bit values."""
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def display_name(c: Column | str) -> Column:
    """Underscores to blanks, words capitalised."""
    return F.initcap(F.replace(col(c), F.lit("_"), F.lit(" ")))


#: Spellings of a copy in a file name, and of a number at its end.
COPY_WORDS = r"(?i)\(\s*custom\s*\)|\bcopy\b"
END_NUMBER = r"(?:[ _-]\d{1,3}|\(\d+\))(?=\s*(?:\([^)]*\)\s*)*$)"


def copy_markers(path: Column | str) -> Column:
    """How many marks of a copy a file name carries: "(custom)", the word "copy",
    and a number of up to three digits (or any in parentheses) at the end."""
    name = stem(path)
    return F.regexp_count(name, F.lit(COPY_WORDS)) + F.regexp_count(name, F.lit(END_NUMBER))


#: Split words as they are published, short or long.
SPLIT_WORDS = {"train": "train", "training": "train", "val": "val", "valid": "val", "validation": "val", "test": "test", "testing": "test"}


def split_word(c: Column | str) -> Column:
    """"train", "val" or "test" for any known spelling; null for others and for missing ones."""
    word = spelled(c)
    out = F.lit(None).cast("string")
    for said, name in SPLIT_WORDS.items():
        out = F.when(word == said, F.lit(name)).otherwise(out)
    return out
