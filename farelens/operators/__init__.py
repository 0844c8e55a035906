"""DataFrame operators: metrics, profiles, search, outliers, questions,
SQL screening and result helpers."""
