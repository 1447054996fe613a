"""Weftline: semi-structured text, property graphs and corpus statistics as Spark plans."""
