"""Training-data pipeline operators: mixing, URL and quality filters, dedup,
extraction, language identification, counting, decontamination and token output.

Nothing outside this subpackage imports it.
"""
