"""DataFrame operators: checks, splits, joins, metrics, features, models."""
