"""DataFrame operators: rating, ranking, totals, statistics, table maintenance."""
