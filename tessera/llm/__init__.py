"""Operations on text, page and vector corpora for training-data pipelines.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames.
"""
