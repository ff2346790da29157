"""Code intelligence and corpus analytics as Spark plans."""
