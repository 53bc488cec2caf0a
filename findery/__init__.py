"""findery: a retrieval-experiment engine on Spark.

Every operator is a function from DataFrames and parameters to a DataFrame; nothing reads the clock
or a table of its own accord.
"""
