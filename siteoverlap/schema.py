"""Schemas of the tables that the operators exchange."""

from pyspark.sql import types as T

#: All observed sites.
UNIVERSE = T.StructType([T.StructField("chrom", T.IntegerType()), T.StructField("pos", T.LongType())])
#: Sites by detection method, numbered from 1.
CANDIDATES = T.StructType([T.StructField("method", T.IntegerType()), *UNIVERSE.fields])
METHODS = T.StructType([T.StructField("method", T.IntegerType()), T.StructField("name", T.StringType())])
PVALUES = T.StructType(
    [T.StructField("scenario", T.StringType()), T.StructField("universe_id", T.IntegerType()), T.StructField("replicate", T.IntegerType()), T.StructField("chrom", T.IntegerType()), T.StructField("p_value", T.DoubleType())]
)
