"""Lexloom: lexical-evidence analytics on Spark DataFrames."""
