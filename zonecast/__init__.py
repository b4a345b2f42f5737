"""zonecast: trip demand panels, forecasts and price search as Spark DataFrame operators."""

__version__ = "0.1.0"
