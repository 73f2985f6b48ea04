"""Relational, raster, index, stability, metric and time-series operators."""
