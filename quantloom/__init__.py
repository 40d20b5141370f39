"""quantloom: equity-factor research and corpus preparation as lazy PySpark plans."""
