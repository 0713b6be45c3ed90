"""dayloom: personal-activity analytics and corpus preparation as Spark DataFrame plans."""
