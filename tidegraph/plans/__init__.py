"""Plan-level helpers: scratch tables, skew handling, the query IR and its compiler."""
