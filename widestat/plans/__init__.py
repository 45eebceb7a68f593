"""Query plans: the notebooks' flow end to end and the registered queries."""
