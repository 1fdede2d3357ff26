"""DataFrame operators: cleaning, features, subgroups, splits, metrics, dual steps, Pareto sets, trial tables."""
