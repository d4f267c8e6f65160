"""Named queries over the operators, with the SQL that must give the same rows."""
