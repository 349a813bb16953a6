"""Preference queries over numeric tables on Spark DataFrames: top-k, skyline, block indexes and their supporting operators."""
