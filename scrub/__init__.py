"""Find, classify, redact and gate sensitive data in tables of files, documents and commits."""
