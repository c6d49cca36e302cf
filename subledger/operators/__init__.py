"""Distributed operators the reports are built from (no UDFs, no driver loops)."""
