"""Reading tables and files, and writing findings."""
