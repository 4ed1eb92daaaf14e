"""DataFrame operators: ordering, injection, scoring, ranking and reports."""
