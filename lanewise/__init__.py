"""Pricing analytics on shipment tables, expressed as Spark DataFrame operators."""

__version__ = "0.1.0"
