"""Query catalogue over the test tables and its SQL twins."""
