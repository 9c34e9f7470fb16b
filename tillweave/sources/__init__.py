"""Where the tables come from and where results and staged intermediates go."""
