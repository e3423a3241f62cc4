"""End-to-end plans, output projection and the registered queries."""
