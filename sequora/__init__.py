"""Sequora: sequence analytics and storage-codec operators as Spark DataFrame plans."""

__version__ = "0.1.0"
