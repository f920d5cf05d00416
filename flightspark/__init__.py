"""Flight-survey analytics on Spark: telemetry, surfels, evidence, rasters, meshes and job reports."""

__version__ = "0.1.0"
