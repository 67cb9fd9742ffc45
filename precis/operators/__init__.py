"""DataFrame -> DataFrame operators (sections 2.3-2.9 of the survey)."""
