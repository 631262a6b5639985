"""corvid: a Spark-native engine for tabular binary classification
(ingest, label, profile, select, split / balance, fit, score, evaluate,
compare, explain), every step a DataFrame-in / DataFrame-out operator."""

__version__ = "0.1.0"
