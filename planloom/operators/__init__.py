"""Operators on DataFrames. `keys` are the columns that tell captures apart; they lead every grouping."""
