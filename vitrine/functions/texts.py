"""Listing size and date texts as numbers and normal forms."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions import patterns as P
from vitrine.functions.binding import let

# str.strip() in most languages also removes non-breaking and other Unicode blanks
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def strip(text: Column) -> Column:
    """Remove blanks of any kind from both ends."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def _scaled(number: Column, unit: Column) -> Column:
    power = F.array_position(F.array(*[F.lit(u) for u in P.SIZE_UNITS]), F.upper(unit))
    valid = F.when(number.rlike(r"^(\d+\.?\d*|\.\d+)$"), number.cast("double"))
    size = F.rint(valid * F.pow(F.lit(1024.0), power.cast("double")))
    return F.when(size < float(1 << 63), size.cast("bigint"))


def size_col(text: Column) -> Column:
    """``2.5K`` or ``2560`` to bytes (1024-based, halves to even); else null."""
    return let(
        strip(text),
        lambda t: _scaled(F.regexp_extract(t, P.SIZE_TEXT, 1), F.regexp_extract(t, P.SIZE_TEXT, 2)),
    )


_NAMED = r"^(\d{2})-([A-Za-z]{3})-(\d{4})\s+(\d{2}:\d{2})"
_ISO = r"^(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2})"


def _normal_mtime(text: Column, month: Column) -> Column:
    from_named = F.concat(
        F.regexp_extract(text, _NAMED, 3), F.lit("-"),
        F.lpad(month.cast("string"), 2, "0"), F.lit("-"),
        F.regexp_extract(text, _NAMED, 1), F.lit("T"), F.regexp_extract(text, _NAMED, 4),
    )
    return (
        F.when(text.isin("", "-"), None)
        .when(month > 0, from_named)
        .when(text.rlike(_ISO), F.concat_ws("T", F.regexp_extract(text, _ISO, 1), F.regexp_extract(text, _ISO, 2)))
        .otherwise(text)
    )


def mtime_col(text: Column) -> Column:
    """Both listing date forms to ``YYYY-MM-DDTHH:MM``; other text is kept; ``-`` is null."""
    months = F.array(*[F.lit(m) for m in P.MONTHS])
    return let(
        strip(text),
        lambda t: let(
            F.array_position(months, F.lower(F.regexp_extract(t, _NAMED, 2))),
            lambda month: _normal_mtime(t, month),
        ),
    )


def mtime_ts(mtime: Column) -> Column:
    """The normal form as a timestamp, null where the text was not recognised."""
    return F.try_to_timestamp(mtime, F.lit("yyyy-MM-dd'T'HH:mm"))
