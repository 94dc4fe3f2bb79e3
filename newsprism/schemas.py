"""Fixed schemas of the data model (news, exposure logs, query logs, raw inputs)."""

from __future__ import annotations

from pyspark.sql import types as T

# Exposure record as it arrives on the wire (JSON lines file or Kafka value).
EXPOSURE_JSON = T.StructType(
    [
        T.StructField("impression_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("news_id", T.StringType()),
        T.StructField("clicked", T.IntegerType()),
        T.StructField("dwell_time", T.DoubleType()),
        T.StructField("processed_timestamp", T.StringType()),
    ]
)

# Stored exposure table; primary key (impression_id, user_id, news_id).
EXPOSURE = T.StructType(
    [
        T.StructField("impression_id", T.StringType(), False),
        T.StructField("user_id", T.StringType(), False),
        T.StructField("news_id", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("clicked", T.IntegerType()),
        T.StructField("dwell_time", T.DoubleType()),
        T.StructField("processed_timestamp", T.TimestampType()),
    ]
)
EXPOSURE_KEY = ("impression_id", "user_id", "news_id")

# Article dimension; primary key news_id. JSON columns stay strings.
NEWS = T.StructType(
    [
        T.StructField("news_id", T.StringType(), False),
        T.StructField("category", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("headline", T.StringType()),
        T.StructField("news_body", T.StringType()),
        T.StructField("title_entity", T.StringType()),
        T.StructField("entity_content", T.StringType()),
    ]
)
NEWS_KEY = ("news_id",)

# Monitoring log of timed report runs; primary key id.
QUERY_LOG = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("query_type", T.StringType()),
        T.StructField("query_params", T.StringType()),
        T.StructField("execution_time", T.DoubleType()),
        T.StructField("result_count", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("error_message", T.StringType()),
    ]
)

# Header names of the raw TSV inputs, mapped to table column names (fixed values).
NEWS_TSV_COLUMNS = {
    "News ID": "news_id",
    "Category": "category",
    "Topic": "topic",
    "Headline": "headline",
    "News body": "news_body",
    "Title entity": "title_entity",
    "Entity content": "entity_content",
}
IMPRESSION_TSV_COLUMNS = ("UserID", "pos", "neg", "dwelltime_pos", "start", "end")
