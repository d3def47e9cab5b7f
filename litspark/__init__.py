"""litspark: a PySpark-native engine for document libraries.

Every operator is a function from DataFrames and parameters to a DataFrame.
"""
