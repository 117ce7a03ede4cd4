"""DataFrame to DataFrame operators of the metric engine."""
