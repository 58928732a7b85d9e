"""DataFrame operators: filters, cohorts, frequency, burden, pairs, browsing and drill-down."""
