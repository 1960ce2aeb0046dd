"""Corvane: corpus retrieval, graph ranking and text preparation as Spark DataFrames."""
