"""Spark-native operators over voxel, cell, lineage and track tables."""
