"""Scalar building blocks as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLOTS = 16384

#: The stop words of text search, English then Malay.
STOP_WORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by
could did do does doing down during each few for from further had has have having he her here hers herself him himself
his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours
ourselves out over own same she should so some such than that the their theirs them themselves then there these they
this those through to too under until up very was we were what when where which while who whom why with would you your
yours yourself yourselves
ada adalah akan antara atau bagi bahkan bahawa banyak bila boleh dalam dan dapat dari daripada dengan di dia ia ini itu
jika juga kami kamu ke kerana kita lagi lalu mana mereka oleh pada para saja sama sangat saya sebagai sedang seperti
sudah supaya tak telah tentang tidak untuk yang
""".split()


def tokens(text: Column) -> Column:
    """Terms of a text: runs of letters and digits in lower case, longer than a byte, no stop words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (F.octet_length(w) > 1) & ~w.isin(STOP_WORDS))  # a set: one lookup a word


def hash_tag(key: Column) -> Column:
    """What stands in the first braces of a key, if anything does, else the key."""
    tag = F.regexp_extract(key, r"\{([^}]*)\}", 1)
    return F.when(tag != "", tag).otherwise(key)


def hash_slot(key: Column) -> Column:
    return (F.crc32(hash_tag(key).cast("binary")) % SLOTS).cast("int")


def size_bytes(column: Column, kind: T.DataType) -> Column:
    """Bytes a value takes: 8 for numbers and times, 1 for booleans and nulls, text and binaries their length, vectors 4 for
    each place, other arrays and structs the sum of their values."""
    if isinstance(kind, T.BooleanType):
        size = F.lit(1)
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(column)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType):
        size = F.size(column) * 4
    elif isinstance(kind, T.ArrayType):
        size = F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + size_bytes(x, kind.elementType))
    elif isinstance(kind, T.StructType):
        size = sum((F.lit(len(f.name)) + size_bytes(column[f.name], f.dataType) for f in kind.fields), F.lit(0))
    else:
        size = F.lit(8)
    return F.when(column.isNull(), F.lit(1)).otherwise(size).cast("long")


_NAMES = {T.BooleanType: "boolean", T.StringType: "string", T.BinaryType: "binary", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.StructType: "object", T.NullType: "null", T.FloatType: "float", T.DoubleType: "float"}


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return "vector" if isinstance(kind.elementType, T.FloatType) else "array"
    return _NAMES.get(type(kind), "integer" if isinstance(kind, T.NumericType) else "object")
