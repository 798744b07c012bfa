"""Column expressions over strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, and the byte-order mark.
SPACES = r"(?U)[\s\x{FEFF}]+"


def norm_key(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; case stays."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def stems(word: Column) -> Column:
    """What an English word may be an inflection of, in a fixed order: plural, past, -ing, -ly, degree, doubled letter, possessive."""
    cut = lambda n: F.substring(word, F.lit(1), F.greatest(F.length(word) - n, F.lit(0)))
    ends = lambda e: word.endswith(e)
    degree = r"(er|est)$"
    doubled = r"(.)\1(ed|ing|er|est)$"
    return F.array_compact(
        F.array(
            F.when(ends("s"), cut(1)),
            F.when(ends("es"), cut(2)),
            F.when(ends("ies"), F.concat(cut(3), F.lit("y"))),
            F.when(ends("ed"), cut(2)),
            F.when(ends("ed"), cut(1)),
            F.when(ends("ied"), F.concat(cut(3), F.lit("y"))),
            F.when(ends("ing"), cut(3)),
            F.when(ends("ing"), F.concat(cut(3), F.lit("e"))),
            F.when(ends("ly"), cut(2)),
            F.when(word.rlike(degree), F.regexp_replace(word, degree, "")),
            F.when(word.rlike(doubled), F.regexp_replace(word, doubled, "$1")),
            F.when(ends("'s"), cut(2)),
        )
    )


def hex_rgb(colour: Column) -> Column:
    """``#rrggbb`` as a struct of shares of one; null for anything else."""
    part = lambda k: F.conv(F.substring(colour, k, 2), 16, 10).cast("double") / 255
    return F.when(colour.rlike("^#[0-9a-fA-F]{6}$"), F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b")))


def plain_number(x: Column) -> Column:
    """At most three decimals, halves upwards, no exponent, no trailing zeros; 0 for NaN, infinities and -0."""
    finite = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)
    thousandths = F.floor(finite * 1000 + 0.5).cast("decimal(38,0)")
    text = (thousandths / F.lit(1000).cast("decimal(10,0)")).cast("decimal(38,3)").cast("string")
    # there are always three decimals, so no zero of the whole number is trimmed
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))


def measured(x: Column) -> Column:
    """No decimals from 100, one from 10, else two."""
    return F.when(x >= 100, F.format_string("%.0f", x)).when(x >= 10, F.format_string("%.1f", x)).otherwise(F.format_string("%.2f", x))


def size_text(n_bytes: Column) -> Column:
    """Kilobytes, or megabytes with one decimal from 1 MiB on; a megabyte figure that lies in the middle goes to the even decimal."""
    return F.when(n_bytes >= 1 << 20, F.format_string("%.1f MB", F.bround(n_bytes / (1 << 20), 1))).otherwise(F.format_string("%.0f KB", n_bytes / 1024))


def family_key(name: Column) -> Column:
    """Lower case without anything but letters and digits."""
    return F.regexp_replace(F.lower(name), r"[^a-z0-9]", "")


def output_name(name: Column, suffix: str) -> Column:
    return F.concat(F.regexp_replace(name, r"(?i)\.pdf$", ""), F.lit(suffix + ".pdf"))


def stamp_text(template: str, page: Column, pages: Column, number: Column, digits: int) -> Column:
    """``template`` with {page}, {pages} and {n}, the number padded with zeros to 1 to 12 digits."""
    width = max(1, min(12, digits))
    shown = F.when(F.length(number.cast("string")) >= width, number.cast("string")).otherwise(F.lpad(number.cast("string"), width, "0"))
    out = F.lit(template)
    for key, value in (("{page}", page.cast("string")), ("{pages}", pages.cast("string")), ("{n}", shown)):
        out = F.replace(out, F.lit(key), value)
    return out


def matched_case(old: Column, new: Column) -> Column:
    """``new`` with a capital where ``old`` has one."""
    return F.when(old.rlike("^[A-Z]"), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))).otherwise(new)
