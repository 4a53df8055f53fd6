"""Registered queries: operators over the adapter's views, each with the SQL it is held against."""
