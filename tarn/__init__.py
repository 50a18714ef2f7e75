"""Ranking of text candidates inside pools, on Spark DataFrames.

Two tables carry everything: candidates(sample_id, pos, context_id, source, text, ...) and long score tables
(score_name, sample_id, pos, score). pos is a candidate's place in its pool and breaks all ties.
"""
