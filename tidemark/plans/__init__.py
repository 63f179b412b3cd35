"""Job plans: the roles the driver's tables play, the end-to-end jobs and
the registry of queries checked against SQL."""
