"""Where tables come from: views of the test tables, and readers of files."""
