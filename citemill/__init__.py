"""Citation analytics and corpus preparation on Apache Spark."""
