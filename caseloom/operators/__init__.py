"""DataFrame -> DataFrame operators of the case-log engine."""
