"""codeloom functions."""
