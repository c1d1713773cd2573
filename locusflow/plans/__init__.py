"""Named queries of the operators and the SQL they must equal."""
