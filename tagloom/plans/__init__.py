"""Query catalogue: every query of the library, bound to the tables of a folder, with its SQL."""
