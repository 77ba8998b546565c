"""Table schemas shared by sources and operators."""

from pyspark.sql import types as T

PACKETS = T.StructType([
    T.StructField("session_id", T.LongType()),
    T.StructField("packet_id", T.LongType()),
    T.StructField("port_drone_id", T.IntegerType()),
    T.StructField("arrival_ts", T.TimestampType()),
    T.StructField("packet", T.BinaryType()),
])

ARRIVALS = T.StructType([
    T.StructField("session_id", T.LongType()),
    T.StructField("packet_id", T.LongType()),
    T.StructField("drone_id", T.IntegerType()),
    T.StructField("frame_num", T.LongType()),
    T.StructField("arrival_ts", T.TimestampType()),
])

BOXES = T.StructType([
    T.StructField("image_id", T.LongType()),
    T.StructField("box_id", T.LongType()),
    T.StructField("cls", T.IntegerType()),
    T.StructField("x1", T.DoubleType()),
    T.StructField("y1", T.DoubleType()),
    T.StructField("x2", T.DoubleType()),
    T.StructField("y2", T.DoubleType()),
])

DETECTIONS = T.StructType(BOXES.fields + [T.StructField("conf", T.DoubleType())])

USERS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("email", T.StringType()),
    T.StructField("password_hash", T.StringType()),
    T.StructField("full_name", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

REVOCATIONS = T.StructType([
    T.StructField("token", T.StringType()),
    T.StructField("blacklisted_at", T.TimestampType()),
    T.StructField("expires_at", T.TimestampType()),
])
