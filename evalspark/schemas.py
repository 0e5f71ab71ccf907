"""Explicit schemas: nothing in the engine infers one from data."""

from pyspark.sql import types as T

TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
META = T.StructType([T.StructField("meta_description", T.StringType())])

# One parsed sample line; unknown keys survive in the raw text next to it.
SAMPLE = T.StructType([T.StructField("meta", META), T.StructField("turns", T.ArrayType(TURN))])

IFEVAL_SPEC = T.StructType([
    T.StructField("instruction_id_list", T.ArrayType(T.StringType())),
    T.StructField("kwargs", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
])

SUMMARY = T.StructType([
    T.StructField("total_count", T.LongType()),
    T.StructField("correct_count", T.LongType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("average_score", T.DoubleType()),
    T.StructField("average_inference_time", T.DoubleType()),
    T.StructField("rouge_scores", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("badcase_count", T.LongType()),
])

RESULT = T.StructType([
    T.StructField("index", T.LongType()),
    T.StructField("original_index", T.LongType()),
    T.StructField("expanded_index", T.LongType()),
    T.StructField("user_input", T.ArrayType(MESSAGE)),
    T.StructField("model_output", T.StringType()),
    T.StructField("reference_output", T.StringType()),
    T.StructField("inference_time", T.DoubleType()),
    T.StructField("test_mode", T.BooleanType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("is_badcase", T.IntegerType()),
    T.StructField("error", T.StringType()),
    T.StructField("details", T.StringType()),
])

# The stored report document.
REPORT = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("config", T.MapType(T.StringType(), T.StringType())),
    T.StructField("summary", SUMMARY),
    T.StructField("badcases", T.ArrayType(RESULT)),
    T.StructField("results", T.ArrayType(RESULT)),
])
