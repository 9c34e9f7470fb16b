"""tillweave: retail campaign, loyalty, pricing and market analytics as plain PySpark DataFrame functions."""
