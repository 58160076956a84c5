"""Schemas of the corpus records."""

from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])
CONTEXT = T.StructType([T.StructField("sentence", T.StringType()), T.StructField("span", SPAN)])
LINK = T.StructType(
    [T.StructField("para", T.IntegerType()), T.StructField("sent", T.IntegerType()), T.StructField("span", SPAN)]
)
TRIPLE = T.StructType([T.StructField(c, T.StringType()) for c in ("subj", "rel", "obj")])
ENTITY = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("desc", T.StringType()),
        T.StructField("aka", T.ArrayType(T.StringType())),
        T.StructField("freq", T.StructType([T.StructField("triple", T.LongType())])),
        T.StructField("qid", T.StringType()),
    ]
)
PAGE = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "url", "title", "text")])
ARTICLE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("pid", T.StringType()),
        T.StructField("qid", T.StringType()),
        T.StructField("text", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("link", T.MapType(T.StringType(), LINK)),
    ]
)
EXAMPLE = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("qid", "title", "name", "desc")],
        T.StructField("contexts", T.ArrayType(CONTEXT)),
    ]
)
