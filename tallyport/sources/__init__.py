"""Table readers: key ranges, time ranges, cursors, pages, catalog, JDBC."""
