"""Factloom: an evidence and fact analytics engine on Spark DataFrames."""
