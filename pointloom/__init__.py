"""Spark-first analytics over fleets of LiDAR and inertial recordings."""
