"""DataFrame operators. Column names are parameters; the defaults are the contract names in ``schemas``."""
