"""Column builders: text cleaning, templates and scoring heads."""
