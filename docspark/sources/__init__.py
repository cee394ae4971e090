"""Reading landing areas and writing audit records."""
