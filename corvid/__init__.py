"""Corvid: the data side of a language-model post-training loop, on Spark DataFrames."""
