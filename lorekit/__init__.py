"""lorekit: Spark jobs over conversation logs and the markdown knowledge bases built from them.

Every operator is a plain function from DataFrames to a DataFrame, written with
native Spark SQL expressions so Catalyst can prune, push down and codegen it.
"""

__version__ = "0.1.0"
