"""Functions of the spatial library: columns (DataFrame API) and registry (SQL)."""
