"""Spreadloom: pair-spread analytics and corpus preparation as Spark jobs."""
