"""Text functions as Column expressions, with the same as DuckDB SQL where queries need it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token separators (fixed values): ASCII controls, space and punctuation but the hyphen; U+0080-BF, multiplication
#: and division signs, U+2000-2070.  Java's and RE2's syntax.
SEPARATORS = r"[\x00-\x2C\x2E\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\x{80}-\x{BF}\x{D7}\x{F7}\x{2000}-\x{2070}]+"
UPPER = "".join(map(chr, [*range(0x41, 0x5B), *range(0x410, 0x430), 0x401]))
LOWER = "".join(map(chr, [*range(0x61, 0x7B), *range(0x430, 0x450), 0x451]))
ACCENT = "́"
ELLIPSIS = "…"


def lowered(text: Column) -> Column:
    """Lower-cases A-Z and the Russian letters, nothing else."""
    return F.translate(text, UPPER, LOWER)


def deyotized(text: Column) -> Column:
    return F.translate(text, "ёЁ", "еЕ")


def unaccented(text: Column) -> Column:
    return F.replace(text, F.lit(ACCENT), F.lit(""))


def normalized(text: Column) -> Column:
    return unaccented(lowered(text))


def tokens(text: Column) -> Column:
    """Array of normalized tokens.  A token of accents only stays, as the empty string; null text has none.

    Lower-casing changes no separator, so it is done once for the whole text; only texts with an accent look at each token again.
    """
    text = F.coalesce(text, F.lit(""))
    parts = F.array_remove(F.split(lowered(text), SEPARATORS), "")
    return F.when(F.contains(text, F.lit(ACCENT)), F.transform(parts, unaccented)).otherwise(parts)


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix in code points."""
    size = F.aggregate(F.sequence(F.lit(0), F.least(F.char_length(a), F.char_length(b))), F.lit(0), lambda n, k: F.when((k == n + 1) & (F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k)), k).otherwise(n))
    return F.substring(a, F.lit(1), size)


def prefix_by(text: Column, delimiters: str) -> Column:
    """What stands before the first delimiter."""
    return F.regexp_extract(text, f"^[^{_class(delimiters)}]*", 0)


def split_by(text: Column, delimiters: str, skip_empty: bool = False) -> Column:
    """Splits at any delimiter; no empty part at the end."""
    parts = F.split(text, f"[{_class(delimiters)}]")
    if skip_empty:
        return F.filter(parts, lambda x: x != "")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def trimmed(text: Column, characters: str) -> Column:
    return F.ltrim(text, F.lit(characters))


def _class(characters: str) -> str:
    return "".join("\\" + c if c in "\\]^-[&" else c for c in characters)


def file_name(title: Column) -> Column:
    """A title as a file name: characters that file systems refuse become underscores."""
    return F.translate(title, '<>:"/\\|?* ', "_" * 10)


def number_cell(value: Column, width: int, decimals: bool = False) -> Column:
    """A number padded on the left; one that is too long keeps its last `width` characters after an ellipsis."""
    s = F.format_string("%.6f", value.cast("double")) if decimals else value.cast("string")
    return F.when(F.char_length(s) > width, F.concat(F.lit(ELLIPSIS), F.right(s, F.lit(width)))).otherwise(F.lpad(s, width, " "))


def text_cell(value: Column, width: int) -> Column:
    """A text padded on the right, or cut to width - 1 characters and an ellipsis."""
    cut = F.left(value, F.lit(width - 1)) if width > 1 else value
    return F.when(F.char_length(value) > width, F.concat(cut, F.lit(ELLIPSIS))).otherwise(F.rpad(value, width, " "))


def sql_tokens(text: str) -> str:
    """DuckDB: a list of normalized tokens."""
    return f"list_transform(list_filter(string_split_regex(coalesce({text}, ''), '{SEPARATORS}'), lambda x: x <> ''), lambda x: replace(translate(x, '{UPPER}', '{LOWER}'), chr(769), ''))"
