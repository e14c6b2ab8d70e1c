"""DataFrame operators of the supply-risk workload."""
