"""Writers and readers of snapshots."""
