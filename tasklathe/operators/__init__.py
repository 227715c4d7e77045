"""Read queries, state transitions, sweeps, matching, routing, metrics and events over snapshots."""
