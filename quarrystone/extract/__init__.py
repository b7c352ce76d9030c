"""From lines and files to typed tables: one function for each table, DataFrame to DataFrame."""
