"""Equality filters over payload keys that have no column of their own.

Other keys of a point live as text in the map ``extra``, where no scan can skip anything. So a stored log also has
``marks``, a struct of ``SLOTS`` numbers: a key has two slots, both hold the hash of the key and its value. A slot is 0
where no key of the row falls into it and ``MIXED`` where several do. A filter on any key, whether or not anybody
thought of it when the log was written, is then an ``IN`` of two numbers on two plain columns; Parquet checks it against
statistics and dictionaries and leaves row groups and files out. The map decides in the end, so marks never change
a result.

Values compare as a JSON reader would: a number equals any text that reads as this number, true and false are the
words, a text equals itself. Keys that a point lacks, and null values, match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLOTS = 16
MIXED = -1
MARKS = T.StructType([T.StructField(f"m{i}", T.LongType()) for i in range(SLOTS)])
_EXACT = 1 << 53


def _slots(key: Column) -> tuple[Column, Column]:
    """Two different slots of a key."""
    h = F.xxhash64(key)
    first = F.pmod(h, F.lit(SLOTS))
    return first, F.pmod(first + 1 + F.pmod(F.shiftright(h, 32), F.lit(SLOTS - 1)), F.lit(SLOTS))


def _mark(key: Column, text: Column) -> Column:
    """Equal for values that may be equal."""
    return F.xxhash64(key, F.coalesce((text.try_cast("double") + 0.0).cast("string"), text))


def marks(extra: Column) -> Column:
    """The marks of a payload map."""
    pairs = F.filter(F.map_entries(extra), lambda e: e.value.isNotNull())
    hashed = F.transform(pairs, lambda e: F.struct(*(s.alias(n) for s, n in zip(_slots(e.key), ("a", "b"))), _mark(e.key, e.value).alias("mark")))

    def slot(i: int) -> Column:
        own = F.transform(F.filter(hashed, lambda h: (h.a == i) | (h.b == i)), lambda h: h.mark)
        # Two keys with one mark cannot be told apart from one, and need not be.
        return F.when(F.coalesce(F.size(own), F.lit(0)) <= 0, F.lit(0).cast("long")).when(F.size(own) == 1, own[0]).otherwise(F.lit(MIXED).cast("long"))

    empty = F.struct(*(F.lit(0).cast("long").alias(f"m{i}") for i in range(SLOTS)))
    filled = F.struct(*(slot(i).alias(f"m{i}") for i in range(SLOTS)))
    return F.when(F.coalesce(F.size(extra), F.lit(0)) <= 0, empty).otherwise(filled)


def text_of(value: object) -> str:
    """A filter's value as the payload holds it."""
    return str(value).lower() if isinstance(value, bool) else str(value)


def _equals(text: Column, value: object) -> Column:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        same = text.try_cast("double") == F.lit(float(value))
        if isinstance(value, int) and abs(value) >= _EXACT:
            same = same & (text.try_cast("decimal(38,0)") == F.lit(str(value)).cast("decimal(38,0)"))
        return same
    return text == F.lit(text_of(value))


def _of_marks(spark, key: str, value: object) -> list[tuple[int, int]]:
    """The slots of a key and what they hold for a value; the expressions above, computed once."""
    row = spark.range(1).select(*(s.alias(n) for s, n in zip(_slots(F.lit(key)), ("a", "b"))),
                                _mark(F.lit(key), F.lit(text_of(value))).alias("mark")).head()
    return [(row["a"], row["mark"]), (row["b"], row["mark"])]


def payload_filter(points: DataFrame, filters: dict[str, object]) -> Column:
    """Conjunction of equalities over columns, or over ``extra`` for other keys."""
    condition = F.lit(True)
    for key, value in filters.items():
        if value is None:
            test = F.lit(False)
        elif key in points.columns:
            plain = isinstance(points.schema[key].dataType, T.StringType)
            test = F.col(f"`{key}`") == F.lit(text_of(value) if plain else value)
        elif "extra" in points.columns:
            test = _equals(F.col("extra")[key], value)
            if "marks" in points.columns:
                for slot, mark in _of_marks(points.sparkSession, key, value):
                    test = F.col(f"marks.m{slot}").isin(mark, MIXED) & test
        else:
            test = F.lit(False)
        condition = condition & test
    return condition
