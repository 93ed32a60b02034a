"""Query catalogue and SQL script execution."""
