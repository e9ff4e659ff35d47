"""Schemas of the input and of the stored tables."""

from pyspark.sql import types as T

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

WEBPAGES = T.StructType([
    T.StructField("hash", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("sitename", T.StringType()),
])

CHUNKS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("pid", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("chunk", T.StringType()),
])

VECTORS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("values", T.ArrayType(T.FloatType())),
])

LINKS = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("depth", T.IntegerType()),
])

STORE_TABLES = {"webpages": WEBPAGES, "chunks": CHUNKS, "vectors": VECTORS, "links": LINKS}
