"""Point-in-time click features, evaluation and calibration on Spark DataFrames.

A feature of an impression on a date uses information from earlier, completed dates alone.
"""
