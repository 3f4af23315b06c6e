"""Inkmesh: notes, links and text corpora as Spark DataFrames."""
