"""DataFrame operators: labels, features, splits, preparation, models, metrics."""
