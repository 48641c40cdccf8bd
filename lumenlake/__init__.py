"""Part of the lumenlake engine."""
