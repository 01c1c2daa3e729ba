"""Lectern: lecture-alignment and corpus analytics on PySpark DataFrames."""
