"""Exact voxel-scene analytics as Spark plans."""
