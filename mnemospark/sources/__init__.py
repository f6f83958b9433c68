"""Inputs: the logical tables, and file formats that the library reads and writes."""
