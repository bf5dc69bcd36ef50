"""Reading and writing: file trees, tables, caches, reports."""
