"""DataFrame operators.  Every public function takes DataFrames and column
names and returns a DataFrame; row order is never implied."""
