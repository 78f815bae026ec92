"""Batch operators for transcript and text datasets on PySpark."""
