"""Reading inputs, staging intermediate tables, writing results."""
