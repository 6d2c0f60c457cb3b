"""Column expressions and schema helpers; nothing here runs a job."""
