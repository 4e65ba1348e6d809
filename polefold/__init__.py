"""Orientation-tomography analytics as Spark DataFrame plans."""
