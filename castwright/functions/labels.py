"""Speaker labels: many spellings of one speaker number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"

# Full-width forms U+FF01..U+FF5E and the ASCII characters they stand for.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "

# Words that stand before a speaker number.
SPEAKER_WORDS = ("speaker", "spkr", "spk", "说话人", "說話人", "发言人", "話者", "讲者")
NUMBERED = rf"^(?:{'|'.join(SPEAKER_WORDS)})?([0-9]+)$"


def narrow(text: Column) -> Column:
    """Full-width letters, digits and signs as ASCII."""
    return F.translate(text, WIDE, NARROW)


def bare_label(label: Column) -> Column:
    """Lower case, narrow, letters and digits only; '' for null."""
    return F.regexp_replace(F.lower(narrow(F.coalesce(label, F.lit("")))), r"[^\p{L}\p{M}\p{N}]", "")


def speaker_number(label: Column) -> Column:
    """The number of a numbered label in any spelling, else null."""
    found = F.regexp_extract(bare_label(label), NUMBERED, 1)
    return F.when(found != "", found.try_cast("bigint"))


def speaker_key(label: Column) -> Column:
    """One value per speaker: 'SPEAKER_07' for numbered labels, 'UNKNOWN' for null, blank or unknown, else the bare name."""
    number, bare = speaker_number(label), bare_label(label)
    return (
        F.when(number.isNotNull(), F.concat(F.lit("SPEAKER_"), F.when(number < 10, F.concat(F.lit("0"), number.cast("string"))).otherwise(number.cast("string"))))
        .when(bare.isin("", "unknown"), F.lit(UNKNOWN))
        .otherwise(bare)
    )
