"""Girder: building-model compliance checking as Spark DataFrame plans."""
