"""suffixloom: variable-length Markov chains over symbol sequences, as Spark DataFrames."""

__version__ = "0.1.0"
