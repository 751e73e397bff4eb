"""Text and value helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# (?U): \s must also match the wide spaces of CJK text.
_SPACE = r"(?U)[\s\x1c-\x1f]+"
# The white space that is stripped from ends of texts.
_ENDS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
_NON_FINITE = r"^\s*[+-]?(?i:inf|infinity|nan)\s*$"


def squash_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def strip_ws(c: Column) -> Column:
    """Strip any Unicode whitespace from both ends; inner whitespace stays."""
    return F.btrim(c, F.lit(_ENDS))


def normalize_text(c: Column) -> Column:
    return squash_spaces(F.lower(c))


def safe_float(c: Column) -> Column:
    """Text to double, null when it is not a number. Java-only forms such as ``1d`` are refused."""
    return F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double")).when(
        c.rlike(_NON_FINITE), F.trim(F.regexp_replace(F.lower(c), r"\+", "")).try_cast("double")
    )


def strip_html(c: Column, max_len: int | None = None) -> Column:
    """Drop tags, then named entities, then outer whitespace; words on both sides of a tag are joined."""
    plain = strip_ws(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), "&[a-zA-Z]+;", ""))
    return plain if max_len is None else F.left(plain, F.lit(max_len))


def bare_symbol(c: Column) -> Column:
    return F.split_part(c, F.lit("."), F.lit(1))


def zero_fill(c: Column, width: int = 6) -> Column:
    """Left-pad with zeros, never shorten; a leading sign stays in front."""
    sign = F.regexp_extract(c, r"^[+-]", 0)
    digits = F.substring(c, F.length(sign) + F.lit(1), F.length(c))
    return F.when(F.length(c) < width, F.concat(sign, F.lpad(digits, F.lit(width) - F.length(sign), F.lit("0")))).otherwise(c)


def sentiment_text(c: Column) -> Column:
    return F.when(c == -1, "negative").when(c == 1, "positive").otherwise("neutral")


def to_timestamp_or_null(c: Column) -> Column:
    return F.try_to_timestamp(c)


def percent_text(c: Column, digits: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", c * 100), F.lit("%"))


def number_text(c: Column) -> Column:
    """A double as plain digits: all that its shortest text has, without an exponent where 38 digits hold it."""
    own = c.cast("string")
    digits = F.regexp_replace(own.try_cast("decimal(38,18)").cast("string"), "0+$", "")
    plain = F.regexp_replace(digits, r"\.$", ".0")
    return F.when(own.contains("E"), F.when(plain.try_cast("double") == c, plain).otherwise(own)).otherwise(own)


def sign_colour(c: Column) -> Column:
    # The two bar colours.
    return F.when(c > 0, "#2ecc71").otherwise("#e74c3c")


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clamp; null stays null (``greatest``/``least`` alone would drop it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, "[/:]", "-")


# Fixed value: the progress line written by a load, "[i/n] name(id=7) 成分股=12".
PROGRESS_LINE = r"\[(\d+)/(\d+)\]\s+(.+?)\(id=(\d+)\)\s+成分股=(\d+)"


def progress_fields(line: Column) -> Column:
    """Struct of one progress line; null when the line is something else."""
    part = lambda i: F.regexp_extract(line, PROGRESS_LINE, i)
    return F.when(
        line.rlike(PROGRESS_LINE),
        F.struct(
            part(1).cast("bigint").alias("current"),
            part(2).cast("bigint").alias("total"),
            part(3).alias("name"),
            part(4).cast("bigint").alias("id"),
            part(5).cast("bigint").alias("stock_count"),
        ),
    )


def eta_text(elapsed_seconds: Column, current: Column, total: Column) -> Column:
    left = elapsed_seconds / F.nullif(current, F.lit(0)) * (total - current)
    minutes = F.floor(left / 60)
    return (
        F.when(current == 0, "计算中...")
        .when(minutes > 60, F.format_string("%dh %dm", F.floor(minutes / 60), minutes % 60))
        .otherwise(F.format_string("%dm %ds", minutes, F.floor(left % 60)))
    )
