"""Spark-native analytics over large catalogs of media assets.

Every operator takes and returns DataFrames, or returns a Column; nothing here
runs an action unless its docstring says so.
"""
