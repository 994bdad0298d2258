"""Operators of a training-data pipeline; nothing outside this folder imports them but the driver's entry file."""
