"""Spark jobs for volumetric instance-segmentation data."""
