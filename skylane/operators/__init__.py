"""Frame operators: each takes and returns a DataFrame, without reading or writing anything."""
