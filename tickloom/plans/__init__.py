"""Query plans: table adapters, the strategy plans and the query catalog."""
