"""Column expressions: every helper takes and returns a Column, no Python UDF anywhere."""
