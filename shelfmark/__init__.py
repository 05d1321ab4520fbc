"""Cataloguing and de-duplication of large archive libraries as Spark jobs."""
