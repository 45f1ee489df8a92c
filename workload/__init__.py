"""The operators run on the test tables, with SQL that says what they must give."""
