"""Review analytics over whole tables of code changes, documents and feedback events."""
