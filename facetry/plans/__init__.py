"""From a metric query to a DataFrame."""
