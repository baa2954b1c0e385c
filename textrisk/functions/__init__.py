"""Column builders: text normalization, rule matching, risk arithmetic, labels."""
