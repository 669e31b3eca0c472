"""Normal forms and keys. All run in the JVM on Spark's own Unicode library.

The normalizing calls are non-deterministic to the optimizer, so project keys first and join on
plain columns afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nfc(text: Column) -> Column:
    """Canonical composition."""
    return F.when(text.isNotNull(), F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False)))


def folded(text: Column) -> Column:
    """Composed, full default case folding, composed again; accents and white space stay."""
    return F.when(text.isNotNull(), nfc(F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfc(text), F.lit(True))))


def lookup_keys(text: Column) -> Column:
    """[authored, composed, folded], the keys of the three classes in order."""
    return F.array(text, nfc(text), folded(text))


def bounded(text: Column, max_bytes: int) -> Column:
    """struct(value, truncated): at most ``max_bytes`` of UTF-8, cut at a character."""
    raw = text.cast("binary")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, max_bytes - k).cast("string")) for k in range(min(3, max_bytes) + 1)]
    long = F.octet_length(text) > max_bytes
    return F.when(text.isNotNull(), F.struct(F.when(long, F.coalesce(*cuts)).otherwise(text).alias("value"), long.alias("truncated")))
