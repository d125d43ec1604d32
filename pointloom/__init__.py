"""Spark-first point-set, contour, graph and raster analytics."""
