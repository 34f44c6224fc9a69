"""Calibration-set preparation, vector compression and run-log analysis on Spark."""
