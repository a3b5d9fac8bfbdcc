"""The registered queries: every operator over the given tables, next to its plain SQL meaning."""
