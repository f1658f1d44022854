"""Drone-survey analytics as Spark DataFrame transformations."""
