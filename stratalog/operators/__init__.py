"""DataFrame-to-DataFrame operators: rows, cleansing, joins, aggregates, windows, ranking, sets."""
