"""Clinical annotation analytics as Spark plans.

Every public function takes and returns DataFrames (or builds a Column), so a
whole corpus job is one lazy plan.  Sequence logic (line order, runs, windows)
is expressed on arrays inside one row wherever the data already arrives as one
row per document or per sentence; that keeps it free of shuffles.
"""
