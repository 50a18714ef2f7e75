"""Operators on candidates, scores, rankings and datasets; DataFrame in, DataFrame out."""
