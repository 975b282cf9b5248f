"""codeloom streaming."""
