"""DataFrame operators: ordered scans, joins in time and space, labels, budgets, merges."""
