"""Where logs come from: tables, files, memory, JDBC."""
