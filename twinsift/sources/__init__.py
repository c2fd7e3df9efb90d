"""Listings, file contents and table storage."""
