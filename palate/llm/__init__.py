"""Operators of a large-scale training-data pipeline.

Nothing outside this folder, the entry module and the pipeline script imports it.
"""
