"""Column expressions for coded answers and fact text."""
