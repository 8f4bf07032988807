"""Functions of the weather and question-log jobs."""
