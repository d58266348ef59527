"""Operators for training-data pipelines: quality, language, toxicity, deduplication, decontamination, mixing, counting.

Nothing else in the package imports this folder. Every operator takes DataFrames, states its result for nulls, empty
texts, ties and repeated rows in its docstring, and cuts lineage only with tables written below ``spark.checkpoint.dir``.
"""
