"""Studies and registered queries, with the SQL each is checked against."""
