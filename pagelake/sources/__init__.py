"""Where pages, dictionaries and models come from, and where results go."""
