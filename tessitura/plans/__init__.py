"""Plans that bring tables into the shapes the operators take."""
