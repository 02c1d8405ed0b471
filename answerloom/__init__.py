"""Answerloom: questionnaire answering over a question/answer knowledge base, on Spark.

Every operator takes DataFrames and returns DataFrames.  Mutations return the
new table snapshot (with an audit table and a one-row summary where the
workflow has one) and never change their input.
"""
