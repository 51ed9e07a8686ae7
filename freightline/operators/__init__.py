"""DataFrame -> DataFrame operators: cleaning, quality, joins, aggregates, windows, ordering."""
