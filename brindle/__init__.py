"""brindle: sensitive-data inspection, policy decisions and their analytics as Spark jobs."""
