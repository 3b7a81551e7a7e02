"""Events, log lines and rule tables derived from the generic test tables, and the query list."""
