"""DataFrame operators: intervals, sampling, metrics, rules, splits, audits."""
