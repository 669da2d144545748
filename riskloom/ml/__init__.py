"""Feature preparation, models, evaluation and the experiment log."""
