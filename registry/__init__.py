"""The registered queries: the reports run over the test tables, and SQL twins to check them."""
