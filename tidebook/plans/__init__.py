"""The query dialect and its planner."""
