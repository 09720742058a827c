"""Snapshots on a shared file system, import and export."""
