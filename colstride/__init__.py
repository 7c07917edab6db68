"""A columnar analytics library on Spark DataFrames: position lists, grouping, codecs, statistics."""
