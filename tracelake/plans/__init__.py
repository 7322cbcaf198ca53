"""Plan shapes shared by the operators: sliced sequences, exact quantiles, lookups."""
