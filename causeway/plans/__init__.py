"""Read jobs: incident correlation, graph expansion, health and detail reports."""
