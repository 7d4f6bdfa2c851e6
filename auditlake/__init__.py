"""Website-audit analytics as Spark DataFrame jobs over a lake of crawl snapshots."""
