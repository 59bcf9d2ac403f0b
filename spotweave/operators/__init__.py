"""Operators on SpatialDataset and its DataFrames."""
