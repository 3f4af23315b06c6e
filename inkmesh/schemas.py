"""Schemas of the note store."""

from pyspark.sql import types as T

NOTES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("content", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType(), False),
        T.StructField("updated_at", T.TimestampNTZType(), False),
        # stands in for insertion order, on which first-wins and last-wins rules depend
        T.StructField("seq", T.LongType(), False),
    ]
)
LINKS = T.StructType([T.StructField("source_note_id", T.StringType(), False), T.StructField("target_note_id", T.StringType(), False)])
SETTINGS = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType())])
GENERATED = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("general_title", T.StringType()),
        T.StructField("connections", T.ArrayType(T.StringType())),
    ]
)
NODES = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("title", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in "xywh")])
