"""Explicit schemas of the inputs; nothing is inferred."""

from pyspark.sql import types as T

VIDEO = T.StructType(
    [
        T.StructField("video_id", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("split", T.StringType()),
        T.StructField("category", T.IntegerType()),
        T.StructField("start time", T.DoubleType()),
        T.StructField("end time", T.DoubleType()),
    ]
)
SENTENCE = T.StructType([T.StructField("video_id", T.StringType()), T.StructField("caption", T.StringType())])
METADATA = T.StructType(
    [T.StructField("videos", T.ArrayType(VIDEO)), T.StructField("sentences", T.ArrayType(SENTENCE))]
)
CAPTION_MAP = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
PREDICTION_MAP = T.MapType(
    T.StringType(),
    T.ArrayType(
        T.StructType([T.StructField("image_id", T.StringType()), T.StructField("caption", T.StringType())])
    ),
)
EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
