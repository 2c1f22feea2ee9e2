"""Training-data operators: classification, decontamination, filters, joins, mixing and sharding.

Nothing outside this subpackage imports it.
"""
