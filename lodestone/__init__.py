"""Lodestone: property-graph analytics and corpus operators on PySpark."""
