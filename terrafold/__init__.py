"""Spatial analytics for PySpark: functions, joins and file formats, Spark first."""
