"""Fixed schemas of captures. They are always passed to the readers, never inferred."""

from pyspark.sql import types as T

LABELS = T.MapType(T.StringType(), T.StringType())

# A line as stored; ts is read as text so that a bad timestamp can be told from none.
ENTRY_WIRE = T.StructType([
    T.StructField("ts", T.StringType()),
    T.StructField("labels", LABELS),
    T.StructField("msg", T.StringType()),
    T.StructField("_corrupt", T.StringType()),
])

LABEL_COUNTS = T.MapType(T.StringType(), T.MapType(T.StringType(), T.LongType()))

INDEX = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("from", T.TimestampType()),
    T.StructField("to", T.TimestampType()),
    T.StructField("lines", T.LongType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("labels", LABEL_COUNTS),
])

METADATA = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("format", T.StringType()),
    T.StructField("started", T.TimestampType()),
    T.StructField("stopped", T.TimestampType()),
    T.StructField("total_lines", T.LongType()),
    T.StructField("total_bytes", T.LongType()),
    T.StructField("labels_seen", T.ArrayType(T.StringType())),
    T.StructField("redaction", T.StructType([
        T.StructField("enabled", T.BooleanType()),
        T.StructField("patterns", T.ArrayType(T.StringType())),
    ])),
])

PUSH_PAYLOAD = T.StructType([
    T.StructField("streams", T.ArrayType(T.StructType([
        T.StructField("stream", LABELS),
        T.StructField("values", T.ArrayType(T.ArrayType(T.StringType()))),
    ]))),
    T.StructField("_corrupt", T.StringType()),
])

# One row per push; the address and the time it took are known only where a receiver adds them.
AUDIT = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("event", T.StringType()),
    T.StructField("remote_ip", T.StringType()),
    T.StructField("lines", T.LongType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("duration_ms", T.DoubleType()),
])
