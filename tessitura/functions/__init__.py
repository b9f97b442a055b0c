"""Column functions: everything here is a Catalyst expression unless it says Arrow."""
