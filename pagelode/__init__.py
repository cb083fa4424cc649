"""Web-page evidence and conversion audit as Spark jobs."""
