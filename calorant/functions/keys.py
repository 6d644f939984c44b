"""Keys and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ABSENT = "<null>"


def _joined(parts: list[Column]) -> Column:
    """Each part behind its length, so that no two lists of parts give one text."""
    return F.concat_ws("|", *(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts))


def surrogate_key(*parts: Column | str) -> Column:
    """SHA-256 of the parts' text; null if any part is."""
    texts = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    present = texts[0].isNotNull()
    for t in texts[1:]:
        present = present & t.isNotNull()
    return F.when(present, F.sha2(_joined(texts), 256))


def state_fingerprint(*parts: Column | str) -> Column:
    """SHA-256 of the parts' text in which a null counts as a value of its own."""
    return F.sha2(_joined([F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit(ABSENT)) for p in parts]), 256)


def readable_time(ts: Column) -> Column:
    """ISO 8601 with microseconds of an instant held in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def percent_encoded(text: Column) -> Column:
    """Percent-encoding of all but letters, digits and -._~, byte by byte of the text's UTF-8."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
