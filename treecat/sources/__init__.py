"""Catalog layouts: detection and scans."""
