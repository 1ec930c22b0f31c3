"""Names that events, metrics and platforms have everywhere."""

from pyspark.sql import types as T

#: Event type -> metric column of the daily rollups.
EVENT_METRICS = {
    "view": "views",
    "open": "opens",
    "install": "installs",
    "reinstall": "reinstalls",
    "time_spent": "time_spent",
    "reactivation": "reactivations",
    "app_open": "app_opens",
    "user_referred": "user_referred",
}
EVENTS = list(EVENT_METRICS)
#: The metric columns of the visitor and link rollups, in order.
METRICS = ["views", "opens", "installs", "reinstalls", "time_spent", "revenue", "reactivations", "app_opens", "user_referred"]
MOBILE = ["ios", "android"]
FREE_MAU = 10_000
ACTION_WINDOW_MINUTES = 5

RAW_EVENT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("project_id", T.LongType()),
    T.StructField("device_id", T.LongType()),
    T.StructField("link_id", T.LongType()),
    T.StructField("engagement_time", T.LongType()),
    T.StructField("data", T.StringType()),
    T.StructField("created_at", T.StringType()),
])
