"""Particle-image analytics on PySpark: sets, boxes, poses, voxels and reconstruction as DataFrames."""
