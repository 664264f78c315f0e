"""rivulet: a Spark-native engine for contextual fact triples.

Everything is a function from DataFrame to DataFrame.  The optional subpackage
``rivulet.llm`` holds operators for training-data preparation; no other module
of the library imports it.
"""
