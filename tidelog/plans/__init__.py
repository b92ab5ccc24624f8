"""Schema evolution and the registered queries of the change feed."""
