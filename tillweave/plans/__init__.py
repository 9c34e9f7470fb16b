"""End-to-end reports: base tables in, one report out. Relations read by several branches are staged once."""
