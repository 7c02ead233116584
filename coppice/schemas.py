"""Record schemas. Readers always pass one of these; nothing is inferred."""

from pyspark.sql import types as T

_TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])

RAW_PROBLEM = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("num_ops", T.IntegerType()),
    T.StructField("final_answer", T.LongType()),
    T.StructField("response_with_mask", T.StringType()),
])
RL_RECORD = T.StructType([
    T.StructField("data_source", T.StringType()),
    T.StructField("prompt", T.ArrayType(_TURN)),
    T.StructField("ability", T.StringType()),
    T.StructField("reward_model", T.StructType([T.StructField("style", T.StringType()),
                                                T.StructField("ground_truth", T.StringType())])),
    T.StructField("extra_info", T.StructType([T.StructField("num_ops", T.IntegerType()),
                                              T.StructField("answer", T.StringType())])),
])
SFT_RECORD = T.StructType([
    T.StructField("data_source", T.StringType()),
    T.StructField("message", T.ArrayType(_TURN)),
    T.StructField("extra_info", T.StructType([T.StructField("num_ops", T.IntegerType()),
                                              T.StructField("final_answer", T.LongType()),
                                              T.StructField("answer_with_mask", T.StringType())])),
])
PREFERENCE_PAIR = T.StructType([T.StructField(n, T.StringType()) for n in ("prompt", "chosen", "rejected")])
METRICS = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("step", T.LongType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
])
GENERATION = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("completion", T.StringType()),
    T.StructField("reward", T.DoubleType()),
    T.StructField("ground_truth", T.StringType()),
])
