"""Functions of the engine; every public function maps DataFrames to DataFrames."""
